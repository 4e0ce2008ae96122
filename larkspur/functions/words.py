"""Words of a text: lower case, without stop words, cut to their stems.

The stems are those of the English Porter2 algorithm without its lists of
exceptions, as a chain of regular expressions that need neither look-around nor
back references. ``#`` and ``~`` mark the end of a word that a later rule of the
same step may change or must leave alone.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Common English words that carry no meaning in a search.
STOP = (
    "a about above after again against all am an and any are as at be because been before being below between both "
    "but by can did do does doing don down during each few for from further had has have having he her here hers "
    "herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on "
    "once only or other our ours ourselves out over own s same she should so some such t than that the their theirs "
    "them themselves then there these they this those through to too under until up very was we were what when where "
    "which while who whom why will with you your yours yourself yourselves"
).split()

#: What stands before a suffix that lies behind the first, and behind the second,
#: consonant that follows a vowel.
_R1 = "[^aeiouy]*[aeiouy]+[^aeiouy].*?"
_R2 = "[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+[^aeiouy].*?"

# What takes the place of which suffixes. The part before a suffix is
# as short as can be, so of two that fit the longer one goes.
_SECOND = {
    "ize": "ization|izer",
    "ate": "ational|ation|ator",
    "ful": "fulness|fulli",
    "ous": "ousness|ousli",
    "ive": "iveness|iviti",
    "ble": "biliti|bli",
    "tion": "tional",
    "less": "lessli",
    "ent": "entli",
    "al": "alism|aliti|alli",
    "ence": "enci",
    "ance": "anci",
    "able": "abli",
    "log": "logi",
}
_THIRD = {"ate": "ational", "tion": "tional", "al": "alize", "ic": "icate|iciti|ical", "": "ness|ful"}
_FOURTH = "ement|ance|ence|able|ible|ment|ant|ent|ism|ate|iti|ous|ive|ize|al|er|ic"
_DOUBLE = "bdfgmnprt"

#: Patterns in order, and what they leave; ``$1`` is the first group.
RULES: list[tuple[str, str]] = [
    ("^y", "Y"),
    ("([aeiou])y", "$1Y"),
    ("sses$", "ss"),
    ("^(..+)ie[sd]$", "$1i"),
    ("^(.)ie[sd]$", "$1ie"),
    ("^(.*[aeiouy].*[^us])s$", "$1"),
    (f"^({_R1})eed(ly)?$", "$1ee"),
    ("^(.*[aeiouy].*[^e]|.*[aiouy])ed(ly)?$", "$1#"),
    ("^(.*[aeiouy].*)ing(ly)?$", "$1#"),
    ("(at|bl|iz)#$", "$1e"),
    *((f"{c}{c}#$", c) for c in _DOUBLE),
    ("^([^aeiouy]*[aeiouy][^aeiouywxY#])#$", "$1e"),
    ("#$", ""),
    ("^(.+[^aeiouy])[yY]$", "$1i"),
    *((f"^({_R1})({old})$", f"$1{new}#") for new, old in _SECOND.items()),
    (f"^({_R1}[cdeghkmnrt]|[^aeiouy]*[aeiouy]+[cdghkmnrt])li$", "$1"),
    ("#$", ""),
    *((f"^({_R1})({old})$", f"$1{new}#") for new, old in _THIRD.items()),
    (f"^({_R2})ative$", "$1"),
    ("#$", ""),
    (f"^({_R2})({_FOURTH})$", "$1#"),
    (f"^({_R2}[st]|[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+[st])ion$", "$1"),
    ("#$", ""),
    (f"^({_R2})e$", "$1"),
    (f"^({_R1})e$", "$1~"),
    ("([aeiouywxY]|[^aeiouy][^aeiouy]|[aeiouy][aeiouy][^aeiouy])~$", "$1"),
    ("~$", "e"),
    (f"^({_R2}l|[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+l)l$", "$1"),
    ("Y", "y"),
]

#: The endings that some rule is about; no other word is changed.
TOUCHED = "(s|d|y|i|e|g|al|er|or|ic|ll|ant|ent|ism|ful|ion)$"


def stem(word: Column) -> Column:
    """The stem of a word in lower case; words of up to two characters stay, and so do
    those with an ending that no rule is about."""
    cut = reduce(lambda w, rule: F.regexp_replace(w, F.lit(rule[0]), F.lit(rule[1])), RULES, word)
    return F.when((F.length(word) > 2) & word.rlike(TOUCHED), cut).otherwise(word)


def stem_of(word: str) -> str:
    """The stem of one word, on the driver: by the same rules."""
    if len(word) <= 2:
        return word
    return reduce(lambda w, rule: re.sub(rule[0], rule[1].replace("$1", r"\1"), w), RULES, word)


def stems_of(text: str) -> list[str]:
    """What :func:`stems` gives, on the driver."""
    return [stem_of(w) for w in re.findall("[a-z0-9]+", text.lower()) if w not in STOP]


def stems(text: Column) -> Column:
    """The stems of a text's words (runs of a-z and 0-9) in order, without stop words."""
    words = F.split(F.lower(text), "[^a-z0-9]+")
    return F.transform(F.filter(words, lambda w: (w != "") & ~w.rlike(f"^({'|'.join(STOP)})$")), stem)
