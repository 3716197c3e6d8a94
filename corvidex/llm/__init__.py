"""Operators for training-data pipelines. Nothing outside this folder imports it."""

QUERY_MODULES = (
    "corvidex.llm.q_conversations",
    "corvidex.llm.q_defects",
    "corvidex.llm.q_pii",
    "corvidex.llm.q_sizes",
    "corvidex.llm.q_survivors",
    "corvidex.llm.q_textform",
)
