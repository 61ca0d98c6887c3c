"""Turkish suffix chains read from the right, as one regular expression on the reversed suffix.

A chain of greedy optional groups that ends in (.*)$ can't fail and so never backtracks: it
takes what a loop that strips the longest suffix first takes, stage by stage. Chains of one
stage are cut into their suffixes by the same alternation, and suffixes mapped to tags.
"""

from __future__ import annotations

import itertools
import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes and their tags. "|" parts the tags of one suffix.
BUFFER_N = {"nı": "Case=Acc", "ni": "Case=Acc", "nu": "Case=Acc", "nü": "Case=Acc", "na": "Case=Dat", "ne": "Case=Dat"}
CASES = {
    "Case=Abl": "ndan nden dan den tan ten", "Case=Loc": "nda nde da de ta te", "Case=Gen": "nın nin nun nün ın in un ün",
    "Case=Ins": "yla yle la le", "Case=Equ": "ca ce", "Case=Acc": "yı yi yu yü ı i u ü", "Case=Dat": "ya ye a e",
}
POSSESSIVES = {
    "Poss=Yes|Person[psor]=1|Number[psor]=Plur": "ımız imiz umuz ümüz",
    "Poss=Yes|Person[psor]=2|Number[psor]=Plur": "ınız iniz unuz ünüz",
    "Poss=Yes|Person[psor]=3|Number[psor]=Plur": "ları leri",
    "Poss=Yes|Person[psor]=1|Number[psor]=Sing": "ım im um üm m",
    "Poss=Yes|Person[psor]=2|Number[psor]=Sing": "ın in un ün n",
    "Poss=Yes|Person[psor]=3|Number[psor]=Sing": "sı si su sü",
}
AMBIGUOUS, PLURAL = "ı i u ü", "lar ler"
DERIVATIONS = {
    "Deriv=LIK|DerivPOS=NOUN": "lık lik luk lük", "Deriv=SAL|DerivPOS=ADJ": "sal sel", "Deriv=LI|DerivPOS=ADJ": "li lı lu lü",
    "Deriv=SIZ|DerivPOS=ADJ": "siz suz süz sız", "Deriv=CI|DerivPOS=NOUN": "ci cı cu cü çı çi çu çü",
}
TENSES = {
    "Verbal=Past": "dı di du dü tı ti tu tü", "Verbal=Evidential": "mış miş muş müş",
    "Verbal=Progressive": "yor", "Verbal=Future": "acak ecek",
}
SECOND_PERSON = {"Verbal=2ndPersonPlural": "sınız siniz sunuz sünüz", "Verbal=2ndPersonSingular": "sın sin sun sün"}
FIRST_SINGULAR = {"Verbal=1stPersonSingular": "m ım im um üm", "Verbal=Past|Verbal=1stPersonSingular": "dım dim dum düm tım tim tum tüm"}
FIRST_PLURAL = {"Verbal=1stPersonPlural": "ık ik uk ük ız iz uz üz", "Verbal=Past|Verbal=1stPersonPlural": "dık dik duk dük tık tik tuk tük"}
INFINITIVE = {"Verbal=Infinitive": "mak mek"}
VERBALIZER, PASSIVE = {"Verbal=Verbalizer": "la le"}, {"Verbal=PassiveInchoative": "lan len"}
LEFTOVER = "Unparsed=Leftover"


def by_suffix(*tables: dict[str, str]) -> dict[str, str]:
    return {s: tag for t in tables for tag, ss in t.items() for s in ss.split()}


CASE, POSSESSIVE, DERIVATION = by_suffix(CASES), by_suffix(POSSESSIVES), by_suffix(DERIVATIONS)
CLOSED = sorted({*BUFFER_N, *CASE, *POSSESSIVE, *PLURAL.split(), *DERIVATION})
"""All nominal suffixes."""


def reversed_any(suffixes: list[str] | dict[str, str]) -> str:
    """Alternation of the reversed suffixes, longest first."""
    return "|".join(s[::-1] for s in sorted(suffixes, key=lambda s: -len(s)))


STAGE_CASE = f"{reversed_any(BUFFER_N)}|{reversed_any(CASE)}"
STAGE_POSSESSIVE = f"{reversed_any({s: t for s, t in POSSESSIVE.items() if len(s) == 4})}|{reversed_any({s: t for s, t in POSSESSIVE.items() if len(s) < 4})}|{'|'.join(AMBIGUOUS.split())}"
STAGE_DERIVATION = reversed_any(DERIVATION)
NOMINAL = rf"(?s)^((?:{STAGE_CASE})*)((?:{STAGE_POSSESSIVE})*)((?:{reversed_any(PLURAL.split())})?)((?:{STAGE_DERIVATION})*)(.*)$"


def nominal_closed(suffix: str) -> bool:
    """Whether a suffix parses without a leftover."""
    return re.match(NOMINAL, suffix[::-1])[5] == ""


FULL = [s for s in CLOSED if len(s) >= 2 and nominal_closed(s)]
"""Suffixes of two letters and more that are parsed whole."""


def tag_map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for s, t in table.items() for x in (s[::-1], t)])


def nominal(suffix: Column) -> Column:
    """struct(segments, ud, deriv, amb), tags sorted; null of a null."""
    r = F.reverse(F.lower(suffix))
    part = [F.regexp_extract(r, NOMINAL, i) for i in range(1, 6)]

    def cut(g: Column, stage: str) -> Column:
        return F.regexp_extract_all(g, F.lit(f"({stage})"), F.lit(1))

    case, poss, deriv = cut(part[0], STAGE_CASE), cut(part[1], STAGE_POSSESSIVE), cut(part[3], STAGE_DERIVATION)
    one = lambda g: F.filter(F.array(g), lambda x: x != "")
    back = F.concat(case, poss, one(part[2]), deriv, one(part[4]))

    def tags(parts: Column, table: dict[str, str]) -> Column:
        found = F.transform(parts, lambda s: F.split(F.coalesce(F.try_element_at(tag_map(table), s), F.lit("")), r"\|"))
        return F.filter(F.flatten(found), lambda x: x != "")

    plural = F.when(part[2] != "", F.array(F.lit("Number=Plur"))).otherwise(F.array().cast("array<string>"))
    ud = F.concat(tags(case, {**CASE, **BUFFER_N}), tags(poss, POSSESSIVE), plural)
    left = F.when(part[4] != "", F.array(F.lit(LEFTOVER))).otherwise(F.array().cast("array<string>"))
    amb = F.when(F.exists(poss, lambda s: s.isin(*AMBIGUOUS.split())), F.array(F.lit("Amb=P3sg_or_Acc"))).otherwise(F.array().cast("array<string>"))
    tidy = lambda a: F.array_sort(F.array_distinct(a))
    return F.when(
        suffix.isNotNull(),
        F.struct(F.transform(F.reverse(back), lambda s: F.reverse(s)).alias("segments"), tidy(ud).alias("ud"), tidy(F.concat(tags(deriv, DERIVATION), left)).alias("deriv"), amb.alias("amb")),
    )


def has_nominal_analysis(token: Column) -> Column:
    """A closed suffix of two letters or more, parsed whole, behind a stem of two or more."""
    t = F.lower(token)
    tests = [F.right(t, F.lit(n)).isin(*[s for s in FULL if len(s) == n]) & (F.length(t) > n + 1) for n in (4, 3, 2)]
    return F.coalesce(tests[0] | tests[1] | tests[2], F.lit(False))


class Level(NamedTuple):
    agreement: dict[str, str]
    tense: dict[str, str]


LEVELS = {
    "4a": Level({}, {}),
    "4b": Level(by_suffix(SECOND_PERSON), by_suffix(TENSES)),
    "4c1": Level(by_suffix(FIRST_SINGULAR), {}),
    "4e": Level(by_suffix(SECOND_PERSON, FIRST_SINGULAR), by_suffix(TENSES)),
}


RESPELLED = (("ş",), ("ı",), ("ş", "ı"))
INFORMAL = {"ş": "s", "ı": "i"}


def spellings(table: dict[str, str], informal: bool) -> dict[str, str]:
    """The suffixes with their tags; informal adds each way to write ş as s and ı as i."""
    out = dict(table)
    if informal:
        for s in sorted(table, key=lambda s: -len(s)):
            for v in itertools.product(*[(c, INFORMAL[c]) if c in INFORMAL else (c,) for c in s]):
                out.setdefault("".join(v), table[s])
    return out


def informal_any(table: dict[str, str], informal: bool) -> str:
    """Reversed alternation: literal suffixes longest first, then those that fit once s reads as
    ş, i as ı, or both, longest first within each."""
    order = [s[::-1] for s in sorted(table, key=lambda s: -len(s))]
    literal = list(order)
    if informal:
        for letters in RESPELLED:
            for s in literal:
                v = "".join(f"[{c}{INFORMAL[c]}]" if c in letters else c for c in s)
                if v not in order:
                    order.append(v)
    return "|".join(order)


def verbal_pattern(level: str, informal: bool = False) -> str:
    """Pattern on the reversed suffix: (agreement and tense, or infinitive), (passive or
    verbalizer), (leftover)."""
    agr, ten = LEVELS[level]
    a, t, i = (informal_any(x, informal) for x in (agr, ten, by_suffix(INFINITIVE)))
    finite = f"(?:(?:{a})(?:{t})?)|(?:{t})|" if a and t else f"(?:{a})|" if a else ""
    return rf"(?s)^({finite}(?:{i})|)((?:{informal_any(by_suffix(PASSIVE), informal)}|{informal_any(by_suffix(VERBALIZER), informal)})?)(.*)$"


def verbal(suffix: Column, level: str = "4c1", informal: bool = False, plural_first: bool = False) -> Column:
    """struct(segments, tags, whole): agreement, tense, else infinitive, then passive or
    verbalizer. plural_first strips a first person plural before them. Unknown levels raise."""
    agr, ten = LEVELS[level]
    inf, pas, ver = by_suffix(INFINITIVE), by_suffix(PASSIVE), by_suffix(VERBALIZER)
    a, t = informal_any(agr, informal), informal_any(ten, informal)
    s = F.lower(suffix)
    plural = by_suffix(FIRST_PLURAL)
    rx_plural = rf"^({reversed_any(plural)})"
    r = F.reverse(s)
    head = F.regexp_extract(r, rx_plural, 1) if plural_first else F.lit("")
    r = F.substr(r, F.length(head) + 1)
    rx = verbal_pattern(level, informal)
    g1, g2, g3 = (F.regexp_extract(r, rx, i) for i in (1, 2, 3))
    if a and t:
        pieces = F.regexp_extract(g1, rf"^((?:{a})?)", 1)
        whole_agr = F.when(g1.rlike(rf"^(?:{a})"), pieces).otherwise("")
        rest = F.substr(g1, F.length(whole_agr) + 1)
    else:
        whole_agr, rest = (F.when(g1.rlike(rf"^(?:{a})"), g1).otherwise("") if a else F.lit("")), F.lit("")
        rest = F.when(whole_agr == "", g1).otherwise("")

    def tags(piece: Column, *tables: dict[str, str]) -> Column:
        m = {k: v for tab in tables for k, v in spellings(tab, informal).items()}
        return F.filter(F.split(F.coalesce(F.try_element_at(tag_map(m), piece), F.lit("")), r"\|"), lambda x: x != "")

    parts = F.filter(F.array(head, whole_agr, rest, g2), lambda x: x != "")
    agr_tags = tags(whole_agr, agr) if agr else F.array().cast("array<string>")
    rest_tags = tags(rest, {**ten, **inf})
    found = F.concat(tags(head, plural) if plural_first else F.array().cast("array<string>"), agr_tags, rest_tags, tags(g2, pas, ver))
    return F.when(
        suffix.isNotNull(),
        F.struct(F.transform(F.reverse(parts), lambda x: F.reverse(x)).alias("segments"), F.array_sort(F.array_distinct(found)).alias("tags"), (g3 == "").alias("whole")),
    )
