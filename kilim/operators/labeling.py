"""Language labels of tokens and sentences: lexicon, shape, entity, suffix and vote rules.

The lexicon, a language-identification table and entities are inputs. Lexicon lookups are
broadcast joins while the lexicon has at most BROADCAST_WORDS words, shuffled ones beyond;
a token's label needs no shuffle, a sentence's vote one, with partial sums per task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilim.functions import morphology as m
from kilim.functions import text as t

BROADCAST_WORDS = 1_000_000
TOP_RANK = 1000
VOWELS = "aeıioöuü"
REDACTED = "REDACTED"


@dataclass(frozen=True)
class Config:
    per_item: bool = True
    matrix: bool = True
    embedded: bool = True
    sentence_id: bool = True
    entities: bool = True
    en_min: float = 0.80
    tr_min: float = 0.80
    strict: bool = True
    mixed_tr: float = 0.6
    mixed_en: float = 0.4


def lexicon(words: DataFrame) -> DataFrame:
    """(word, tr_top, tr_all, en) from (word, lang, word_rank); blank words left out, a null
    rank is not among the top. Repeated words are merged."""
    w = words.select(F.lower(F.split(t.strip(F.col("word")), r"\s+")[0]).alias("word"), F.upper("lang").alias("lang"), "word_rank").where("word <> ''")
    tr, en = F.col("lang") == "TR", F.col("lang") == "EN"
    return w.groupBy("word").agg(
        F.max(F.coalesce(tr & (F.col("word_rank") < TOP_RANK), F.lit(False))).alias("tr_top"), F.max(F.coalesce(tr, F.lit(False))).alias("tr_all"), F.max(F.coalesce(en, F.lit(False))).alias("en")
    )


class Lookups:
    """Left joins with the lexicon and the optional (token_l, lang, prob) table."""

    def __init__(self, lex: DataFrame, lid: DataFrame | None = None, config: Config = Config()):
        small = lex.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
        self.lex = F.broadcast(lex) if small else lex
        self.lid, self.config = lid, config

    def flags(self, df: DataFrame, key: Column, name: str) -> DataFrame:
        """df with name: struct(top, all, en, lid_en, lid_tr) of the key's word."""
        k = f"__{name}"
        df = df.withColumn(k, key)
        lex = self.lex.select(F.col("word").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ("tr_top", "tr_all", "en")])
        df = df.join(lex, k, "left")
        if self.lid is not None:
            lid = self.lid.select(F.lower("token_l").alias(k), F.upper("lang").alias(f"{k}_lang"), F.col("prob").alias(f"{k}_prob"))
            df = df.join(lid, k, "left")
            en = F.coalesce((F.col(f"{k}_lang") == "EN") & (F.col(f"{k}_prob") >= self.config.en_min), F.lit(False))
            tr = F.coalesce((F.col(f"{k}_lang") == "TR") & (F.col(f"{k}_prob") >= self.config.tr_min), F.lit(False))
        else:
            en = tr = F.lit(False)
        flag = [F.coalesce(F.col(f"{k}_{c}"), F.lit(False)) for c in ("tr_top", "tr_all", "en")]
        df = df.withColumn(name, F.struct(flag[0].alias("top"), flag[1].alias("all"), flag[2].alias("en"), en.alias("lid_en"), tr.alias("lid_tr")))
        return df.drop(*[c for c in df.columns if c.startswith(k)])


def word_label(flags: str) -> Column:
    """TR-top, EN, TR-all, then language identification, else UID."""
    c = F.col(flags)
    return F.when(c.top, "TR").when(c.en, "EN").when(c["all"], "TR").when(c.lid_en, "EN").when(c.lid_tr, "TR").otherwise("UID")


def suffix_base(token: Column, n: int) -> Column:
    """The cleaned base of a token that ends in a closed suffix of n letters, else null."""
    low = F.lower(token)
    base = F.lower(t.clean(F.left(token, F.greatest(F.length(token) - n, F.lit(0)))))
    fits = F.right(low, F.lit(n)).isin(*[s for s in m.CLOSED if len(s) == n]) & (F.length(base) >= 2)
    linked = ~F.substr(low, F.length(low) - n + 1, F.lit(1)).isin("y", "n") | F.right(base, F.lit(1)).isin(*VOWELS)
    return F.when(fits & linked, base)


def entity_flags(entities: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, token, named, guarded) of each piece of the entities (keys, text, type): pieces of
    a time only aren't named; those of persons, places and compound organizations are guarded."""
    word = r"[\p{L}\p{N}_]+['’]?[\p{L}\p{N}_]*|[\p{L}\p{N}_]+"
    e = entities.select(*keys, "type", F.regexp_extract_all("text", F.lit(word), F.lit(0)).alias("pieces"))
    proper = F.transform("pieces", lambda p: p.rlike(r"^\p{Lu}\p{L}*$"))
    e = e.select(*keys, "type", F.size("pieces").alias("n"), F.size(F.filter(proper, lambda x: x)).alias("n_proper"), F.explode(F.arrays_zip(F.col("pieces").alias("p"), proper.alias("u"))).alias("x"))
    others = F.col("n_proper") - F.col("x.u").cast("int")
    guard = F.col("type").isin("PERSON", "LOCATION") | ((F.col("type") == "ORGANIZATION") & (F.col("n") > 1) & (others > 0))
    return e.groupBy(*keys, F.col("x.p").alias("token")).agg(F.max(F.coalesce(F.col("type"), F.lit("")) != "TIME").alias("named"), F.max(F.coalesce(guard, F.lit(False))).alias("guarded"))


def gives_way(token: Column, flags: str) -> Column:
    """A named token that an English lexicon word overrides: bare, no Turkish word or analysis,
    no placeholder, acronym or identifier."""
    c = F.col(flags)
    caps = token.rlike(r"\p{Lu}") & ~token.rlike(r"\p{Ll}") & (F.length(token) > 1)
    return ~token.rlike("['’]") & c.en & ~c["all"] & ~c.top & (token != REDACTED) & ~caps & ~token.rlike(r"\p{Nd}") & ~m.has_nominal_analysis(token)


def label(tokens: DataFrame, look: Lookups, entities: DataFrame | None = None, keys: tuple[str, ...] = ("doc_id", "sent_no")) -> DataFrame:
    """tokens with `shape`, `flags` and `label`. Null tokens keep a null label.

    tokens: (keys, token, ...). entities: (keys, text, type).
    """
    tok = F.col("token")
    df = tokens.withColumn("shape", t.shape(tok)).withColumn("__apo", t.apostrophe_parts(tok))
    df = look.flags(df, F.lower(t.clean(tok)), "flags")
    df = look.flags(df, F.lower(tok), "__whole")
    df = look.flags(df, F.lower(t.clean(F.col("__apo.base"))), "__base")
    for n in (4, 3, 2):
        df = look.flags(df, suffix_base(tok, n), f"__b{n}")
    named = F.lit(False)
    if entities is not None and look.config.entities:
        df = df.join(entity_flags(entities, keys), [*keys, "token"], "left")
        named = F.coalesce(F.col("named") & (F.col("guarded") | ~gives_way(tok, "flags")), F.lit(False))
    bases = [F.coalesce((F.col(f"__b{n}.en") | F.col(f"__b{n}.lid_en")) & (~F.col(f"__b{n}.all") if look.config.strict else F.lit(True)) & suffix_base(tok, n).isNotNull(), F.lit(False)) for n in (4, 3, 2)]
    inner = ~F.col("__whole.all") & (bases[0] | bases[1] | bases[2])
    word, base = word_label("flags"), F.when(F.col("__apo").isNotNull(), word_label("__base"))
    lab = F.when(tok.isNull(), None).when(F.col("shape").isNotNull(), "OTHER").when(named, "NE").when(base == "EN", "MIXED")
    lab = lab.when((base == "TR") & F.lit(look.config.per_item), "TR").when((word != "TR") & inner, "MIXED").otherwise(word)
    out = df.withColumn("label", lab)
    return out.drop("__apo", "__whole", "__base", "__b4", "__b3", "__b2", "named", "guarded")


def vote(labels: Column, config: Config = Config()) -> tuple[Column, Column]:
    """(matrix, embedded) as aggregates over a sentence's labels: ties are Turkish."""
    n = {k: F.count(F.when(labels == k, 1)) for k in ("TR", "EN", "MIXED")}
    matrix = F.when(n["TR"] + F.lit(config.mixed_tr) * n["MIXED"] >= n["EN"] + F.lit(config.mixed_en) * n["MIXED"], "TR").otherwise("EN")
    embed = F.when((matrix == "TR") & (n["EN"] + n["MIXED"] > 0), "EN").when((matrix == "EN") & (n["TR"] + n["MIXED"] > 0), "TR").otherwise("-")
    return matrix, embed


def sentence_votes(labelled: DataFrame, keys: tuple[str, ...] = ("doc_id", "sent_no"), config: Config = Config()) -> DataFrame:
    """(keys, matrix_lang, embed_lang, n_tokens); a sentence without tokens is TR with -."""
    matrix, embed = vote(F.col("label"), config)
    return labelled.groupBy(*keys).agg(matrix.alias("matrix_lang"), embed.alias("embed_lang"), F.count("token").alias("n_tokens"))


def annotate(docs: DataFrame, look: Lookups, entities: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(tokens with labels, sentences with votes) of documents, one cascade from text on."""
    tok = label(t.tokens(t.sentences(docs, key, text), (key, "sent_no"), outer=True), look, entities, (key, "sent_no"))
    return tok.where("token is not null"), sentence_votes(tok, (key, "sent_no"), look.config)


def annotated_rows(tokens: DataFrame, votes: DataFrame, config: Config = Config(), key: str = "doc_id") -> DataFrame:
    """(key, sent_no, ridx, idx, token, label): the row model of the annotated table, meta rows
    SentenceID before and MatrixLang, EmbedLang behind the tokens, as the toggles say."""
    v = votes
    head = [v.select(key, "sent_no", F.lit(-1).alias("o"), F.lit("SentenceID").alias("token"), F.col("sent_no").cast("string").alias("label"))] if config.sentence_id else []
    if config.per_item:
        head.append(tokens.select(key, "sent_no", F.col("pos").alias("o"), "token", "label"))
    big = 2**30
    if config.matrix:
        head.append(v.select(key, "sent_no", F.lit(big).alias("o"), F.lit("MatrixLang").alias("token"), F.col("matrix_lang").alias("label")))
    if config.embedded:
        head.append(v.select(key, "sent_no", F.lit(big + 1).alias("o"), F.lit("EmbedLang").alias("token"), F.col("embed_lang").alias("label")))
    out = head[0]
    for h in head[1:]:
        out = out.unionByName(h)
    return out
