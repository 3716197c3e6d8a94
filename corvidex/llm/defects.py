"""Broken prompt and response pairs (problem 4).

Each pair gets at most one defect, the first that holds of

* ``empty``: the answer holds nothing, or only a mark or heading for no content;
* ``copy``: the answer says nothing but the prompt again, whole or nearly so;
* ``refusal``: every sentence declines or sends the reader elsewhere;
* ``language``: the language posteriors of prompt and answer (character n-gram naive
  Bayes) disagree clearly, and the prompt did not ask for the answer's language;
* ``truncated``: the text's last shapes are unlikely to end a text (n-gram model), or a
  fence, bracket or announced list is left open.

The models are fitted on bounded samples (see ``language``); the pairs are then judged in
one pass over the scan, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvidex.llm.emptiness import is_blank, is_empty
from corvidex.llm.language import EndingModel, LanguageModel, clean_prose

#: Leads (nats over all n-gram orders) from which a posterior counts as clear.
PROMPT_LEAD, ANSWER_LEAD = 40.0, 40.0
#: Probability of ending below which an unfinished-looking end is a truncation: the middle of a plateau (0.005
#: to 0.04 tell the same ends apart at sf0.1; of answers cut at random 1.9 % escape, 2.9 % at 0.01 and 0.2 % at 0.05).
END_PROBABILITY = 0.013

# fixed values: names of languages, by label
LANGUAGE_NAMES = {
    "en": r"english|angielsk|englisch|anglais|английск",
    "pl": r"polish|polsk|polnisch|polonais|польск",
    "de": r"german|deutsch|niemieck|allemand|немецк",
    "fr": r"french|francusk|französisch|franzoesisch|français|francais|французск",
    "ru": r"russian|rosyjsk|russisch|russe|русск",
    "es": r"spanish|hiszpańsk|spanisch|espagnol|испанск",
}

_REFUSALS = (
    # English: a first person that will or may not do what was asked. Verbs of mere observation
    # (cannot reproduce, cannot find) are reports, not refusals.
    r"\b(?:i|we)\b[^.;]{0,40}\b(?:can't|cannot|can not|can’t|won't|won’t|will not|unable to|not able to|not allowed to|not permitted to|not willing to)\s+"
    r"(?!reproduce|touch|find|see|observe|confirm|locate|detect|measure|tell why|wait)",
    r"\b(?:i|we)\b[^.;]{0,30}\b(?:must|have to|need to|am going to have to|will have to) (?:decline|refuse|pass|stop|say no)\b",
    r"\b(?:i|we) (?:decline|refuse)\b|\b(?:i|we) have been (?:told|asked|instructed) not to\b",
    r"\b(?:i'd|i would|we'd|we would|i) (?:much )?(?:rather|prefer) not\b|\bi (?:choose|prefer) not to\b",
    r"(?:\bnot|n't|n’t) (?:feel |be )?(?:appropriate|comfortable|authori[sz]ed|permitted|allowed|willing|in a position)\b",
    r"\b(?:prevent|forbid|prohibit|stop|keep|bar)s? me from\b|\bdo(?:es)? not (?:allow|permit) me\b",
    r"\b(?:outside|beyond|past) (?:of )?(?:what (?:i|we) (?:am|are|can|may)|my (?:scope|remit|role|limits))\b|\boff[- ]limits\b|\bout of bounds\b",
    r"\bnot something (?:i|we) (?:can|am|are|will|may)\b|\bno (?:answer|help|reply|support) can be (?:given|offered)\b|\bnothing i can (?:do|offer|say)\b",
    r"\bsomething (?:i|we) (?:have to|must|need to) (?:refuse|decline)\b|\b(?:against|violates?) (?:the|my|our) (?:policy|policies|rules|guidelines)\b",
    r"\b(?:i|we) (?:may|must|should|shall) not\b|\b(?:i|we) (?:shouldn't|mustn't)\b|\bno (?:permission|authority|mandate) to\b|\bnot (?:for|up to) me to\b"
    r"|\bpolic(?:y|ies) (?:does|do) not (?:allow|permit)\b|\bnot going to (?:help|do|answer|work|discuss|comment)\b|\bturn(?:ing)? (?:this|that|it) down\b|\bpass on this\b",
    # Polish
    r"\bnie mam (?:prawa|uprawnień|zgody)\b|\bodrzucam\b|\bnie wolno\b",
    r"\bnie (?:spełnię|pomogę|odpowiem|wykonam|zrobię|podejmę|udzielę|będę|chcę|zajmuję|zajmę|czuję|wypada mi|powinienem|powinnam)\b",
    r"\bnie (?:mogę|możemy|jestem|jesteśmy|wolno mi|wolno nam)\b(?! (?:już )?(?:odtworzyć|znaleźć|potwierdzić))",
    r"\bodmówić\b|\bodmawiam\b|\bodmówię\b|\bwolę nie\b|\bwolał\w+ nie\b|\bwykracza poza\b|\bpoza tym, co\b|\bnie pozwala\w* mi\b|\bzabrania\w* mi\b|\bzasady\b.*\bnie pozwal",
    # German
    r"\b(?:muss|möchte) ich\b.*\bablehnen\b|\bich (?:muss|möchte)\b.*\bablehnen\b|\blehne ich\b|\bich lehne\b",
    r"\b(?:kann|darf|werde|möchte|will) ich\b.*\b(?:nicht(?! mehr)|kein\w*)\b|\bich (?:kann|darf|werde|möchte|will)\b.*\b(?:nicht(?! mehr)|kein\w*)\b",
    r"\baußerhalb (?:dessen|meiner)\b|\bnicht (?:erlaubt|gestattet|befugt|in der lage|zulässig)\b|\buntersag|\bverbiet|\bhindern mich\b|\blieber nicht\b",
    r"\bweigere ich\b|\bich weigere\b|\bnicht berechtigt\b|\bsteht mir nicht\b",
    # French
    r"\bje décline\b|\bje m'abstiens\b|\bpas de mon ressort\b|\bje ne pourrai(?:s)? pas\b",
    r"\bje (?:dois|préfère|souhaite) (?:refuser|décliner|ne pas|m'abstenir)\b|\bje refuse\b|\bje ne (?:peux|suis|veux|souhaite|saurais|dois|vais)(?: pas)?\b(?! plus)",
    r"\bne m'est pas (?:permis|possible)\b|\bm'interdi|\bm'empêch|\bhors de (?:mes|ce)\b|\b(?:dépasse|sort de) (?:ce|mes|mon)\b|\bpas (?:autorisée?|en mesure)\b",
)
_REFUSAL = re.compile("|".join(_REFUSALS), re.I)
_ELSEWHERE = re.compile(
    r"\b(?:you may want to|please (?:ask|contact|consult)|ask (?:the|your|someone)|contact (?:the|your)"
    r"|zapytaj|proszę (?:zapytać|zwrócić)|bitte (?:fragen|wenden)|wenden sie|fragen sie|demandez|adressez|veuillez)",
    re.I,
)
_APOLOGY = re.compile(r"^\W*(?:sorry|apologies|i am sorry|i'm sorry|i apologi[sz]e|przykro mi|wybacz|przepraszam|es tut mir leid|tut mir leid|entschuldigung|désolée?|je suis désolée?)\W*$", re.I)
_SENTENCE = re.compile(r"(?<=[.!?])[\s ]+")
_TOKEN = re.compile(r"[^\W_]+")
_FENCE = re.compile(r"^[ \t]*(?:```|~~~)", re.M)
_CODE = re.compile(r"```.*?```|`[^`\n]*`", re.S)
_TERMINAL = ".!?…。»\"”'’"


def is_refusal(answer: str) -> bool:
    """Every sentence declines, apologises or sends elsewhere, and one declines."""
    declined = False
    for s in _SENTENCE.split(answer.strip()):
        if _REFUSAL.search(s):
            declined = True
        elif s.strip() and not _ELSEWHERE.search(s) and not _APOLOGY.match(s):
            return False  # a sentence that says something: most answers end here at once
    return declined


def is_copy(prompt: str, answer: str) -> bool:
    """The answer is the prompt: at most a fifth of the words differ, or a short lead-in is added."""
    p, a = _TOKEN.findall(prompt.casefold()), _TOKEN.findall(answer.casefold())
    if not p or not a:
        return bool(prompt.strip()) and prompt.strip() == answer.strip()
    if len(p) < 3:
        return p == a
    told, asked = list(zip(a, a[1:])), set(zip(p, p[1:]))
    if len(a) > 1 and sum(x in asked for x in told) >= 0.85 * len(told) and len(asked & set(told)) >= 0.8 * len(asked):
        return True  # the prompt again, once or several times
    if not (0.6 <= len(a) / len(p) <= 1 + 6 / len(p) + 0.3):
        return False
    same = sum((Counter(p) & Counter(a)).values())
    extra, missing = len(a) - same, len(p) - same
    close = missing <= max(1, 0.2 * len(p))
    if close and extra <= max(1, 0.2 * len(p)):
        return True
    return missing == 0 and extra <= 6 and a[len(a) - len(p) :] == p


def is_open(answer: str) -> bool:
    """A fence, bracket or announced list is left open at the end."""
    if len(_FENCE.findall(answer)) % 2:
        return True
    text = _CODE.sub(" ", answer).rstrip()
    if text.endswith((":", ",", ";", "(", "[", "{", "/")) or re.search(r"(?:^|\n)[ \t]*(?:[-*+]|\d+[.)])$", text):
        return True
    last = text[text.rfind("\n") + 1 :]
    return any(last.count(o) > last.count(c) for o, c in ("()", "[]", "{}"))


def is_truncated(answer: str, model: EndingModel) -> bool:
    return bool(truncated([answer], model)[0])


def truncated(answers: list[str], model: EndingModel) -> np.ndarray:
    """Unlikely ends, by the model; then an exact check for what is left open, and none for closing signs."""
    texts = [a.rstrip() for a in answers]
    unlikely = model.probabilities(texts) < END_PROBABILITY
    return np.array([is_open(t) or (u and t[-1:] not in _TERMINAL) for t, u in zip(texts, unlikely, strict=True)], dtype=bool)


def asked_for(prompt: str, label: str) -> bool:
    names = LANGUAGE_NAMES.get(label)
    return bool(names and re.search(names, prompt, re.I))


@dataclass
class PairJudge:
    languages: LanguageModel
    endings: EndingModel

    def judge(self, prompts: list[str], answers: list[str]) -> list[str | None]:
        """Defects of pairs that both have content."""
        out: list[str | None] = [None] * len(prompts)
        cleaned = [clean_prose(x) for x in (*prompts, *answers)]
        best, lead = self.languages.best(cleaned)
        n = len(prompts)
        clear = (lead[:n] >= PROMPT_LEAD) & (lead[n:] >= ANSWER_LEAD) & (best[:n] != best[n:])
        cut = truncated(answers, self.endings)
        for i, (p, a) in enumerate(zip(prompts, answers, strict=True)):
            if is_copy(p, a):
                out[i] = "copy"
            elif is_refusal(a):
                out[i] = "refusal"
            elif clear[i] and not asked_for(p, self.languages.labels[best[n + i]]):
                out[i] = "language"
            elif cut[i]:
                out[i] = "truncated"
        return out


def pair_defects(df: DataFrame, id_column: str, prompt: str, answer: str, judge: PairJudge) -> DataFrame:
    """``id_column`` and ``defect_type`` of the defective pairs.

    A NULL, blank or placeholder answer is ``empty`` whether or not there is a prompt;
    a row without a prompt but with an answer has no defect. Whole texts are judged,
    repeated rows each count, an empty table gives an empty result.
    """
    rows = df.select(
        F.col(id_column).alias("id"), F.col(prompt).alias("p"), F.col(answer).alias("a"), is_empty(F.col(answer)).alias("empty"), is_blank(F.col(prompt)).alias("bare")
    ).where("empty or not bare")
    kind = rows.schema["id"].dataType.simpleString()

    def run(frames):
        for f in frames:
            defect = np.where(f["empty"], "empty", "").astype(object)
            rest = np.flatnonzero(~f["empty"].to_numpy(bool))
            found = judge.judge(f["p"].iloc[rest].tolist(), f["a"].iloc[rest].tolist())
            defect[rest] = [x or "" for x in found]
            keep = defect != ""
            yield pd.DataFrame({"id": f["id"][keep], "defect_type": defect[keep]})

    return rows.mapInPandas(run, f"id {kind}, defect_type string").withColumnRenamed("id", id_column)
