"""Per-document text quality statistics and the structural kind of a text.

Every line's characters and words are counted by class; runs of lines of one layout form
segments. A segment's class distributions are compared with profiles by Jensen-Shannon
divergence: prose profiles are taken per language from clean prose, the others are fixed
structural profiles. The nearest profile names the segment's kind, and the kind with the
greater part of the characters names the document's.

Counts over the whole corpus (document frequency of words) come from one aggregation over
all documents; only words in a fixed share of them are kept, so that their number is bounded
by (distinct words per document) / share whatever the corpus' size. The prose profiles are
aggregated over all prose texts in the same way, however many there are.

Nulls and blank texts have zero counts, null shares and no kind. Whole texts are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilim.session import spread

COMMON_SHARE = 0.0005
"""A word is common if this share of the documents hold it, and at least COMMON_LEAST."""
COMMON_LEAST = 3
FUNCTION_SHARE, FUNCTION_LEAST = 0.08, 2
"""A function word stands in this share of a language's prose texts, and in so many of them."""

CHAR_CLASSES = ("vowel", "consonant", "upper", "digit", "space", "stop", "delimiter", "joint", "symbol", "picture")
WORD_CLASSES = ("function", "common", "unknown", "number", "mixed")
LENGTH_CLASSES = ("1", "2", "3", "4-5", "6-8", "9+")

VOWELS = frozenset("aeıioöuüâîûàáâäãåæèéêëìíîïòóôõøœùúûüyÿ")
STOPS = frozenset(".?!…,")
ENDS = (".", "?", "!", "…", ".”", '."', "?”", "!”", '?"', '!"', ":)", ")", "”", '"')
JOINTS = frozenset("'’‘“”\"()-–—:&")
DELIMITERS = frozenset("|;\t=")
LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
WORD = re.compile(r"[^\W\d_]{2}")
BULLET = re.compile(r"\s*(?:[-*•·▪◦‣+]|\d{1,4}[.)]|\[[ xX]?\]|[a-zA-Z][.)])\s+")
SPEAKER = re.compile(r"\s*(?:>+|\[?\d{1,2}[:.]\d{2}(?::\d{2})?\]?|[-–—])\s+")
COLUMN = re.compile(r"\S(?: {2,}|\t+)(?=\S)")


def words_of(text: str) -> list[str]:
    return [w.lower().replace("i̇", "i") for w in LETTERS.findall(text)]


def char_class(c: str) -> str:
    if c.islower() or (c.isalpha() and not c.isupper()):
        return "vowel" if c in VOWELS else "consonant"
    if c.isalpha():
        return "upper"
    if c.isdigit():
        return "digit"
    if c in DELIMITERS:
        return "delimiter"
    if c.isspace():
        return "space"
    if c in STOPS:
        return "stop"
    if c in JOINTS:
        return "joint"
    return "symbol" if ord(c) < 0x2190 else "picture"


_class: dict[str, str] = {}
SEEN_MOST = 200_000
"""Pieces whose class a process keeps; others are worked out each time they come."""


def char_counts(text: str) -> Counter:
    out: Counter = Counter()
    for c, n in Counter(text).items():
        k = _class.get(c)
        if k is None:
            k = _class[c] = char_class(c)
        out[k] += n
    return out


def word_class(piece: str, function: frozenset, common: frozenset) -> str | None:
    """The class of a blank-separated piece; None if it has no core."""
    core = piece.strip(".,;:!?…|=()[]\"'“”‘’*•>#-–—~_")
    if not core:
        return None
    if core.isdigit() or (core[:1].isdigit() and not any(ch.isalpha() for ch in core)):
        return "number"
    if LETTERS.fullmatch(core):
        w = core.lower().replace("i̇", "i")
        stem = w.replace("’", "'").split("'")[0]
        return "function" if w in function else "common" if w in common or stem in common else "unknown"
    parts = words_of(core)
    known = parts and all(x in common or x in function for x in parts) and not any(ch.isdigit() for ch in core)
    return "common" if known else "mixed"


def word_counts(text: str, function: frozenset, common: frozenset, seen: dict[str, str | None] | None = None) -> Counter:
    """Classes of a text's pieces; seen: classes of pieces met before, up to SEEN_MOST."""
    out: Counter = Counter()
    if seen is None:
        seen = {}
    for p, n in Counter(text.split()).items():
        if p in seen:
            k = seen[p]
        else:
            k = word_class(p, function, common)
            if len(seen) < SEEN_MOST:
                seen[p] = k
        if k:
            out[k] += n
    return out


def jsd(p: dict[str, float], q: dict[str, float]) -> float:
    """Jensen-Shannon divergence in bits of two distributions given as class: share."""
    out = 0.0
    for k, a in p.items():
        b = q.get(k, 0.0)
        if a:
            out += a * math.log2(2 * a / (a + b))
        if b:
            out += b * math.log2(2 * b / (a + b))
    # what q has besides lies at one bit
    return (out + sum(b for k, b in q.items() if k not in p)) / 2


def shares(c: Counter) -> dict[str, float]:
    n = sum(c.values())
    return {k: v / n for k, v in c.items()} if n else {}


def length_class(n: int) -> str:
    return "1" if n <= 1 else str(n) if n <= 3 else "4-5" if n <= 5 else "6-8" if n <= 8 else "9+"


# Structural profiles, fixed: shares of word classes and of line lengths in words.
# Character classes of lists follow those of prose, as both are made of words.
JUNK = (
    {"unknown": 1.0},
    {"mixed": 1.0},
    {"unknown": 0.5, "mixed": 0.5},
    {"unknown": 0.3, "mixed": 0.5, "number": 0.2},
)
LIST_WORDS = ({"common": 0.95, "unknown": 0.05}, {"common": 0.92, "function": 0.08}, {"common": 0.66, "number": 0.34})
LIST_LENGTHS = ({"1": 0.65, "2": 0.35}, {"2": 0.5, "3": 0.3, "4-5": 0.2}, {"3": 0.6, "6-8": 0.4}, {"4-5": 0.6, "6-8": 0.4})
PROSE_LENGTHS = ({"9+": 1.0}, {"9+": 0.7, "6-8": 0.3}, {"4-5": 0.2, "6-8": 0.4, "9+": 0.4})
REPEAT_DISTINCT, REPEAT_WORDS, NO_LETTERS = 0.15, 12, 0.35
TABLE_LINES = 3


class Profiles:
    """prose: {language: (characters, words)} shares of clean prose."""

    def __init__(self, prose: list[tuple[dict, dict]], function: frozenset, common: frozenset):
        self.prose, self.function, self.common = prose, function, common
        self.seen: dict[str, str | None] = {}

    def __getstate__(self):
        return {**self.__dict__, "seen": {}}

    def word_counts(self, text: str) -> Counter:
        return word_counts(text, self.function, self.common, self.seen)

    @classmethod
    def of(cls, samples: list[tuple[str, str]], common: frozenset) -> Profiles:
        """samples: (language, clean prose text). Function words are what occurs in a
        quarter or more of a language's samples of ten words and over, or is short and frequent."""
        by: dict[str, list[str]] = {}
        for lang, text in samples:
            by.setdefault(lang or "", []).append(text or "")
        function: set[str] = set()
        for texts in by.values():
            df = Counter(w for t in texts for w in set(words_of(t)))
            function |= {w for w, n in df.items() if n >= max(FUNCTION_LEAST, FUNCTION_SHARE * len(texts))}
        f = frozenset(function)
        return cls([(shares(char_counts("\n".join(t))), shares(word_counts("\n".join(t), f, common))) for t in by.values()], f, common)

    def prose_distance(self, chars: dict, words: dict) -> float:
        return min((jsd(chars, c) + jsd(words, w) for c, w in self.prose), default=1.0)

    def nearest(self, text: str, lines: list[str], layout: str) -> str:
        """prose, list or junk of a segment that isn't laid out as a table."""
        cc, wc = char_counts(text), self.word_counts(text)
        chars, words = shares(cc), shares(wc)
        letters = sum(cc[k] for k in ("vowel", "consonant", "upper"))
        visible = sum(cc.values()) - cc["space"]
        tokens = [w for w in words_of(text) if len(w) > 1]
        if layout == "noise" or (visible and letters < NO_LETTERS * visible and not any(w in self.common for w in tokens)):
            return "junk"  # nothing to hold against a language
        if len(tokens) >= REPEAT_WORDS and len(set(tokens)) <= max(2, REPEAT_DISTINCT * len(tokens)) and len(lines) < len(tokens) / 2:
            return "junk"
        lengths = shares(Counter(length_class(len(LETTERS.findall(x))) for x in lines))
        language = min((jsd(chars, c) for c, _ in self.prose), default=0.0)
        prose = min((jsd(words, w) for _, w in self.prose), default=0.5) + language
        junk = min(jsd(words, j) for j in JUNK)
        if not words or min(prose, min(jsd(words, x) for x in LIST_WORDS) + language) > junk:
            return "junk"
        ended = sum(x.rstrip().endswith(ENDS) for x in lines) / len(lines)
        as_list = min(jsd(lengths, x) for x in LIST_LENGTHS) + min(jsd(words, x) for x in LIST_WORDS) + ended
        marked = layout == "entry" and sum(bool(BULLET.match(x)) or " = " in x for x in lines) >= len(lines) / 2
        as_prose = min(jsd(lengths, x) for x in PROSE_LENGTHS) + min((jsd(words, w) for _, w in self.prose), default=0.5) + (1 - ended) * (0.5 if marked else 0.1)
        return "list" if as_list < as_prose else "prose"


def delimiter(line: str) -> tuple[str, int] | None:
    """The delimiter of a line in columns and how often it stands there."""
    if (n := line.count("|")) >= 2:
        return "|", n
    if n := line.count("\t"):
        return "\t", n
    if (n := line.count(";")) and not line.rstrip().endswith(ENDS):
        return ";", n
    if (n := len(COLUMN.findall(line.strip()))) and not line.rstrip().endswith((".", "?", "!")):
        return "  ", n
    if (n := line.count(",")) >= 2 and not line.rstrip().endswith((".", "?", "!")):
        fields = line.split(",")
        if sum(f.strip().replace(".", "").isdigit() for f in fields) >= len(fields) / 2 or max(len(f.split()) for f in fields) <= 3:
            return ",", n
    return None


def layouts(lines: list[str]) -> list[str]:
    """table, entry (of a list), noise (no word of letters) or open, for each line."""
    marks = [delimiter(x) for x in lines]
    out = []
    for x, m in zip(lines, marks):
        words = len(LETTERS.findall(x))
        if m:
            out.append("column")
        elif not WORD.search(x):
            out.append("noise")
        elif not x.rstrip().endswith(ENDS[:4]) and (BULLET.match(x) or (" = " in x) or words <= 7) and not (SPEAKER.match(x) and words > 7):
            out.append("entry")
        else:
            out.append("open")
    # columns count where enough neighbouring lines share the delimiter and the number of fields
    i = 0
    while i < len(out):
        if out[i] != "column":
            i += 1
            continue
        j = i
        while j < len(out) and marks[j] == marks[i]:
            j += 1
        kind = "table" if j - i >= TABLE_LINES else None
        for k in range(i, j):
            near = kind or ("table" if (k and out[k - 1] == "table" and marks[k][0] == (marks[k - 1] or "?")[0]) else None)
            out[k] = near or ("open" if lines[k].rstrip().endswith(ENDS[:4]) or len(LETTERS.findall(lines[k])) > 7 else "entry")
        i = j
    return out


def segments(text: str) -> Iterator[tuple[str, list[str]]]:
    lines = [x for x in text.split("\n") if x.strip()]
    run: list[str] = []
    layout = ""
    for x, k in zip(lines, layouts(lines)):
        if k != layout and run:
            yield layout, run
            run = []
        layout = k
        run.append(x)
    if run:
        yield layout, run


def kind_of(text: str | None, profiles: Profiles) -> str | None:
    """prose, list, table or junk by the greater part of the characters; None if blank."""
    size: Counter = Counter()
    for layout, lines in segments(text or ""):
        block = "\n".join(lines)
        size["table" if layout == "table" else profiles.nearest(block, lines, layout)] += len(block)
    if not size:
        return None
    kind, n = size.most_common(1)[0]
    return kind if kind == "prose" or n > size["prose"] else "prose"


COLUMNS = ("n_words", "mean_word_len", "symbol_ratio", "end_punct_share", "common_share", "prose_jsd", "kind")
SCHEMA = "n_words long, mean_word_len double, symbol_ratio double, end_punct_share double, common_share double, prose_jsd double, kind string"


def stats_of(text: str | None, profiles: Profiles) -> tuple:
    if text is None or not text.strip():
        return 0, None, None, None, None, None, None
    words = words_of(text)
    cc = char_counts(text)
    visible = sum(cc.values()) - cc["space"]
    odd = visible - sum(cc[k] for k in ("vowel", "consonant", "upper", "digit"))
    lines = [x for x in text.split("\n") if x.strip()]
    ended = sum(x.rstrip().endswith(ENDS[:4]) for x in lines)
    common = sum(w in profiles.common for w in words)
    far = profiles.prose_distance(shares(cc), shares(profiles.word_counts(text)))
    return (
        len(words),
        sum(map(len, words)) / len(words) if words else None,
        odd / visible if visible else None,
        ended / len(lines),
        common / len(words) if words else None,
        far,
        kind_of(text, profiles),
    )


def document_frequency(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): in how many texts a lower-case word of letters stands; counted map-side first."""
    low = F.regexp_replace(F.lower(F.col(text)), "i̇", "i")
    words = F.array_distinct(F.regexp_extract_all(low, F.lit(r"\p{L}+"), F.lit(0)))
    return df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def common_words(df: DataFrame, text: str = "text") -> frozenset:
    """Words in COMMON_SHARE of all texts and in COMMON_LEAST of them."""
    least = max(COMMON_LEAST, math.ceil(COMMON_SHARE * df.count()))
    return frozenset(r.word for r in document_frequency(df, text).where(F.col("n") >= least).select("word").toLocalIterator())


def summed(prose: DataFrame, count: Callable[[list[str]], Counter]) -> DataFrame:
    """(lang, part, key, n): what count gives for (part, key) of texts of one language, summed
    over all rows of (lang, text); each batch is counted before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(b["lang"], b["text"]):
                by.setdefault(lang, []).append(text)
            rows = [(lang, *k, n) for lang, texts in by.items() for k, n in count(texts).items()]
            yield pd.DataFrame(rows, columns=["lang", "part", "key", "n"])

    counts = spread(prose).mapInPandas(run, "lang string, part string, key string, n long")
    return counts.groupBy("lang", "part", "key").agg(F.sum("n").alias("n"))


def chars_and_words(texts: list[str]) -> Counter:
    """Characters by class, and in how many of the texts each word stands."""
    out: Counter = Counter()
    for t in texts:
        out.update({("char", k): n for k, n in char_counts(t).items()})
        out.update(("word", w) for w in set(words_of(t)))
    return out


def profiles_of(docs: DataFrame, prose: DataFrame, text: str = "text") -> Profiles:
    """Profiles.of over all rows of prose (lang, text), without bringing texts to the driver: it
    gets the counts of classes and the function words of each language."""
    common = common_words(docs, text)
    prose = prose.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    texts = {r.lang: r.n for r in prose.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not texts:
        return Profiles([], frozenset(), common)
    least = F.create_map(*(F.lit(x) for k, n in texts.items() for x in (k, float(max(FUNCTION_LEAST, FUNCTION_SHARE * n)))))
    kept = summed(prose, chars_and_words).where((F.col("part") == "char") | (F.col("n") >= least[F.col("lang")]))
    # texts are joined by line breaks, see Profiles.of
    chars = {k: Counter(space=n - 1) for k, n in texts.items()}
    function = set()
    for r in kept.toLocalIterator():
        if r.part == "char":
            chars[r.lang][r.key] += r.n
        else:
            function.add(r.key)
    sent = prose.sparkSession.sparkContext.broadcast(Profiles([], frozenset(function), common))

    def pieces(texts: list[str]) -> Counter:
        out: Counter = Counter()
        for t in texts:
            out.update({("piece", k): n for k, n in sent.value.word_counts(t).items()})
        return out

    words: dict[str, Counter] = {k: Counter() for k in texts}
    for r in summed(prose, pieces).collect():
        words[r.lang][r.key] = r.n
    by = [({c: chars[k][c] for c in CHAR_CLASSES if chars[k][c]}, {c: words[k][c] for c in WORD_CLASSES if words[k][c]}) for k in sorted(texts)]
    return Profiles([(shares(c), shares(w)) for c, w in by], frozenset(function), common)


def statistics(df: DataFrame, profiles: Profiles, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, mean_word_len, symbol_ratio, end_punct_share, common_share, prose_jsd, kind),
    one row for each row; a map without shuffle."""
    sent = df.sparkSession.sparkContext.broadcast(profiles)

    @F.pandas_udf(SCHEMA)
    def run(s: pd.Series) -> pd.DataFrame:
        p = sent.value
        return pd.DataFrame([stats_of(t, p) for t in s], columns=list(COLUMNS))

    return spread(df.select(key, text)).select(key, run.asNondeterministic()(F.col(text)).alias("q")).select(key, "q.*")
