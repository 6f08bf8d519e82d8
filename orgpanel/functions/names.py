"""Organisation names: two normal forms, kinds of parties and of conveyances, same-entity test.

``\\w`` of the patterns is letters, digits and underscore of any script, written out since Java's own is ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

W = r"[\p{L}\p{N}_]"
PUNCT = r"[^\p{L}\p{N}_\s]"
EDGE = rf"(?:(?<={W})(?!{W})|(?<!{W})(?={W}))"

# Words that say nothing about which organisation it is, in the order in which they are tried.
GENERIC = {
    "states": ["del", "de", "ny", "va", "ca", "pa", "oh", "nc", "wi", "ma"],
    "listing": ["plc", "cl", "redh", "adr", "fd", "lp", "cp", "tr", "sp", "cos", "gp", "old", "new"],
    "articles": ["the", "a", "of", "and", "an"],
    "english": ["corporation", "incorporated", "company", "limited", "inc", "llc", "ltd", "corp"],
    "european": ["aktiengesellschaft", "aktiebolag", "ag", "nv", "bv", "gmbh", "co", "bv", "sa", "ab", "se"],
    "japanese": ["kabushiki", "kaisha", "seisakusho"],
    "variants": ["trust", "group", "grp", "hldgs", "holdings", "comm", "inds", "hldg", "tech", "international", "comp"],
}
# Words that mark companies, and other institutions.
COMPANY = "corp co inc llc lp plc ltd limited company corporation incorporated international systems sa oy consulting bank gmbh kabushiki kaisha bv nv sl aktiengesellschaft maschinenfabrik ab ag as spa hf societe associates business industries group kk laboratories works studio telecom investments consultants electronics technologies microsystems multimedia networks technology partnership electric components automotive instruments communication enterprises network engineering designs sciences partners aktiengellschaft venture aerospace pharmaceuticals design medical products pharma energy solutions france isreal product plastics communications kgaa sas cellular gesellschaft se holdings kg srl chimie"
INSTITUTION = "institute university hospital foundation college research administration recherche department trust association ministry laboratory board office univ ecole secretary universidad society universiteit centre center national school institut institutes universite"
# Stems of conveyances that transfer nothing.
NO_TRANSFER = "change secur correct release lien update nunc collat"

CORP, NONPROFIT, INDIVIDUAL = 0, 1, 2
ASSIGN, LICENSE, MERGER, OTHER = 0, 1, 2, 3


def strip(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def weak_name(name: Column) -> Column:
    """Lower case, marks to single blanks."""
    out = F.lower(name)
    for pattern in (r"'s|\(.*\)|\.", PUNCT, r"[ ]{2,}"):
        out = F.regexp_replace(out, pattern, " ")
    return strip(out)


#: (pattern, replacement), in the order in which they must run.
STRONG = [
    (rf"({EDGE}a corp.|;|,).*$", ""),
    (rf"{EDGE}({W}) ({W}) ({W}){EDGE}", "$1$2$3"),
    (rf"{EDGE}({W}) ({W}){EDGE}", "$1$2"),
    (rf"{EDGE}({W})-({W})-({W}){EDGE}", "$1$2$3"),
    (rf"{EDGE}({W})-({W}){EDGE}", "$1$2"),
    (rf"{EDGE}({W}{W})&({W}){EDGE}", "$1$2"),
    (rf"{EDGE}({W})&({W}){EDGE}", "$1$2"),
    (rf"{EDGE}({W}) & ({W}){EDGE}", "$1$2"),
    (r"'s|\(.*\)|\.", ""),
    (PUNCT, " "),
    (rf"{EDGE}(?:{'|'.join(w for words in GENERIC.values() for w in words)}){EDGE}", ""),
    (r" +", " "),
]


def strong_name(name: Column) -> Column:
    """What is left of a name for comparison: acronyms joined, legal forms and generic words dropped."""
    out = F.lower(name)
    for pattern, to in STRONG:
        out = F.regexp_replace(out, pattern, to)
    return strip(out)


def whole_word(words: str) -> str:
    return rf"{EDGE}({'|'.join(words.split())}){EDGE}"


def org_type(name: Column) -> Column:
    """0 company, 1 other institution, 2 individual."""
    n = F.translate(name, "./", "")
    company = n.rlike(whole_word(COMPANY)) | n.rlike("[0-9&()]") | ~n.rlike("[ ,]") | (F.length(n) > 30)
    return F.when(company, CORP).when(n.rlike(whole_word(INSTITUTION)), NONPROFIT).otherwise(INDIVIDUAL)


def convey_type(text: Column) -> Column:
    """0 assignment, 1 license, 2 merger, 3 other."""
    kind = F.when(text.rlike("|".join(NO_TRANSFER.split())), OTHER).when(text.contains("assign"), ASSIGN)
    return kind.when(text.contains("license"), LICENSE).when(text.contains("merge"), MERGER).otherwise(OTHER)


def same_entity(assignor: Column, assignee: Column) -> Column:
    """Whether the characters of one strong name that occur in the other are over half of the mean length."""
    a, b = strong_name(F.coalesce(assignor, F.lit(""))), strong_name(F.coalesce(assignee, F.lit("")))
    shared = F.length(a) - F.length(F.call_function("translate", a, b, F.lit("")))
    return shared / F.greatest(F.lit(1.0), F.lit(0.5) * (F.length(a) + F.length(b))) > 0.5
