"""The gender that a given name suggests: character n-gram naive Bayes, fitted on a short list.

The list holds names of the four languages of the texts; other names are judged by their
letters. Where the letters do not tell, the answer is unknown, which is kept apart.
"""

from __future__ import annotations

import functools
import math
from collections import Counter

# fixed values: names to learn from
FEMALE = (
    "anna maria katarzyna agnieszka barbara krystyna ewa zofia teresa joanna halina irena jadwiga elzbieta beata dorota urszula grazyna monika "
    "mary patricia jennifer linda elizabeth susan jessica sarah karen nancy margaret betty sandra ashley kimberly emily helen carol ruth sharon "
    "ursula monika petra renate gisela ingrid birgit heike karin gudrun ilse hannelore brigitte anke silke ulrike annegret sigrid doris edith "
    "marie nathalie isabelle sylvie catherine francoise valerie christine sophie celine amelie chloe manon ines helene juliette colette "
    "simone yvonne carmen ines astrid judith rachel miriam esther inge"
).split()
MALE = (
    "jan andrzej piotr krzysztof stanislaw tomasz pawel marcin michal jerzy tadeusz adam lukasz zbigniew ryszard dariusz henryk mariusz kazimierz wojciech "
    "james robert john michael david william richard joseph thomas charles christopher daniel matthew anthony mark steven paul andrew joshua kenneth kevin "
    "hans peter wolfgang klaus juergen dieter manfred uwe guenter horst bernd frank heinz gerhard stefan martin joachim rainer ulrich otto fritz "
    "jean pierre michel philippe alain bernard jacques francois nicolas laurent olivier julien antoine luc yves rene etienne guillaume thierry "
    "luca nicola kuba sasha mischa ilja joshua noah elia barnaba bonawentura boleslaw"
).split()
ORDERS = (1, 2, 3)
#: Added to every count, and nats by which one gender must lead.
SMOOTH, LEAD = 0.3, 0.5


def _grams(name: str) -> list[str]:
    """Ends of a name: what tells a gender in these languages stands there."""
    return [f"{name}$"[-n - 1 :] for n in ORDERS]


@functools.cache
def _model() -> dict[str, float]:
    f, m = Counter(g for x in FEMALE for g in _grams(x)), Counter(g for x in MALE for g in _grams(x))
    share = lambda n, names: math.log((n + SMOOTH) / (len(names) + 2 * SMOOTH))
    return {g: share(f[g], FEMALE) - share(m[g], MALE) for g in f | m}


@functools.lru_cache(maxsize=100_000)
def gender_of(name: str) -> str:
    """``f``, ``m`` or ``?`` of a given name."""
    from corvidex.llm.pii import fold

    plain, model = fold(name), _model()
    if (plain in FEMALE) != (plain in MALE):
        return "f" if plain in FEMALE else "m"
    score = sum(model.get(g, 0.0) for g in _grams(plain))
    return "f" if score > LEAD else "m" if score < -LEAD else "?"
