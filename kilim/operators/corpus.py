"""Analysis and editing of the annotated row model.

Rows are (dataset_id, bidx, ridx, token, label, gloss, ...): bidx numbers the sentences of a
data set, ridx the rows of a sentence, meta rows (SentenceID, MatrixLang, EmbedLang) among
them. Running numbers over a data set are made from counts per sentence, so that no task
sorts all rows of a data set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilim.functions import text as t

KEYS = ("dataset_id", "bidx")
KWIC_MOST, CONTEXT_LEAST, CONTEXT_MOST = 5000, 1, 500

# Suffix shapes by length, and their glosses, the first that fits counts.
V = "[ıiuü]"
GLOSSES = (
    (4, rf"l[ae]r{V}", "POSS.3PL"),
    (3, "[dt][ae]n", "ABL"), (3, f"n{V}n", "GEN"), (3, "yl[ae]", "INS|COM"), (3, "n[ae]n", "INS|COM"), (3, "l[ae]r", "PL"), (3, f"{V}.z", "POSS.1PL|POSS.2PL"),
    (3, f"l{V}k", "NMLZ"), (3, f"s{V}z", "PRIV"), (3, f"ms{V}", "SIM"), (3, f"[dt]{V}k", "NMLZ"),
    (2, "[dt][ae]", "LOC"), (2, f"{V}n", "GEN"), (2, "y[ae]", "DAT"), (2, f"y{V}", "ACC"), (2, "l[ae]", "INS|COM"), (2, f"{V}m", "POSS.1SG"), (2, f"s{V}", "POSS.3SG"),
    (2, f"[cç]{V}", "AGT"), (2, f"l{V}", "ATTR"), (2, "c[ae]", "SIM|ADV"), (2, "m[ae]", "NMLZ"), (2, "[ae]n", "PTCP"),
    (1, "[ae]", "DAT"), (1, V, "ACC"),
)


def backwards(shape: str) -> str:
    """A shape of letters, classes and dots for the reversed text."""
    import re

    return "".join(reversed(re.findall(r"\[[^]]*\]|.", shape)))


GLOSS_ANY = "|".join(backwards(s) for _, s, _ in GLOSSES)


def latest(rows: DataFrame, key: str, at: str = "loaded_at") -> DataFrame:
    """The last delivered state of each row; exact repeats fall together."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(at)).alias("r")).select(key, "r.*")


def word_frequencies(rows: DataFrame, labels: tuple[str, ...] = ()) -> DataFrame:
    """(token, n, breakdown): counted forms without meta rows, and "label: n" of each label in
    order; a blank label counts in n alone. labels: only rows of these."""
    r = rows.where(~t.is_meta(F.col("token"))).select(t.frequency_form(F.col("token")).alias("token"), t.strip(F.coalesce("label", F.lit(""))).alias("label")).where("token is not null")
    if labels:
        r = r.where(F.col("label").isin(*labels))
    per = r.groupBy("token", "label").agg(F.count("*").alias("k"))
    parts = F.array_sort(F.collect_list(F.when(F.col("label") != "", F.concat_ws(":", "label", F.col("k").cast("string")))))
    return per.groupBy("token").agg(F.sum("k").alias("n"), F.array_join(parts, ", ").alias("breakdown"))


def label_rows(rows: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    return rows.where(~t.is_meta(F.col("token")) & t.strip(F.col("label")).isin(*labels))


def occurrences(rows: DataFrame, wanted: str, labels: tuple[str, ...] = (), exact_surface: bool = False, case_sensitive: bool = False) -> DataFrame:
    """Rows whose token equals `wanted` in the compared form; a blank query finds nothing."""
    hit = t.match_form(F.col("token"), exact_surface, case_sensitive) == t.match_form(F.lit(wanted), exact_surface, case_sensitive)
    r = rows.where(~t.is_meta(F.col("token")) & hit)
    return r.where(t.strip(F.col("label")).isin(*labels)) if labels else r


def sentence_meta(rows: DataFrame) -> DataFrame:
    """(keys, sent_id, matrix_lang, embed_lang) of each sentence: the last meta row counts, the
    sentence's position stands in for a missing or blank SentenceID."""
    tok, lab = t.strip(F.col("token")), t.strip(F.coalesce("label", F.lit("")))

    def last(name: str, solid: bool = False) -> Column:
        ok = (tok == name) & (lab != "") if solid else tok == name
        return F.max_by(F.when(ok, lab), F.when(ok, F.col("ridx")))

    return rows.groupBy(*KEYS).agg(
        F.coalesce(last("SentenceID", True), (F.col("bidx") + 1).cast("string")).alias("sent_id"),
        F.coalesce(last("MatrixLang"), F.lit("")).alias("matrix_lang"),
        F.coalesce(last("EmbedLang"), F.lit("")).alias("embed_lang"),
    )


def mixed_rows(rows: DataFrame) -> DataFrame:
    """(keys, ridx, sent_id, token, gloss) of MIXED tokens."""
    r = rows.where(F.upper(t.strip(F.col("label"))) == "MIXED").where(~t.is_meta(F.col("token")))
    return r.join(sentence_meta(rows), list(KEYS)).select(*KEYS, "ridx", "sent_id", "token", "gloss")


def grid_search(rows: DataFrame, needle: str) -> DataFrame:
    """(keys, ridx, col): cells of token, label and gloss that hold the needle in any case; a
    blank needle finds nothing."""
    cells = F.array(*[F.struct(F.lit(i).alias("col"), F.coalesce(F.col(c), F.lit("")).alias("value")) for i, c in enumerate(("token", "label", "gloss"), start=1)])
    hit = F.contains(F.lower("c.value"), F.lit(needle.lower())) if needle else F.lit(False)
    return rows.select(*KEYS, "ridx", F.explode(cells).alias("c")).where(hit).select(*KEYS, "ridx", "c.col")


def before_block(counts: DataFrame, n: str) -> DataFrame:
    """(keys, before): sum of n over the earlier sentences of the data set; one row a sentence."""
    w = Window.partitionBy("dataset_id").orderBy("bidx").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*KEYS, F.coalesce(F.sum(n).over(w), F.lit(0)).alias("before"))


def renumber(rows: DataFrame) -> DataFrame:
    """rows with idx: running number over the data set's tokens, null on meta rows."""
    rows = rows.drop("idx")
    tok = (~t.is_meta(F.col("token"))).cast("long")
    counts = rows.groupBy(*KEYS).agg(F.sum(tok).alias("n"))
    inner = F.sum(tok).over(Window.partitionBy(*KEYS).orderBy("ridx").rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("__in", inner).join(before_block(counts, "n"), list(KEYS))
    return out.withColumn("idx", F.when(tok == 1, F.col("before") + F.col("__in"))).drop("__in", "before")


def grid_view(rows: DataFrame) -> DataFrame:
    """(dataset_id, vis_r, bidx, ridx, is_sep, token, label, gloss): rows as shown, with a
    separator behind every sentence but the data set's last."""
    counts = rows.groupBy(*KEYS).agg((F.count("*") + 1).alias("n"))
    last = Window.partitionBy("dataset_id")
    start = before_block(counts, "n").withColumn("is_last", F.col("bidx") == F.max("bidx").over(last))
    at = F.row_number().over(Window.partitionBy(*KEYS).orderBy("ridx")) - 1
    body = rows.withColumn("at", at).join(start, list(KEYS)).select("dataset_id", (F.col("before") + F.col("at")).alias("vis_r"), "bidx", "ridx", F.lit(False).alias("is_sep"), "token", "label", "gloss")
    none = F.lit(None).cast("string")
    seps = start.join(counts, list(KEYS)).where(~F.col("is_last")).select("dataset_id", (F.col("before") + F.col("n") - 1).alias("vis_r"), "bidx", F.lit(None).cast("int").alias("ridx"), F.lit(True).alias("is_sep"), none.alias("token"), none.alias("label"), none.alias("gloss"))
    return body.unionByName(seps)


def kwic(docs: DataFrame, pattern: str, literal: bool = True, ignore_case: bool = True, context: int = 30, key: str = "doc_id", text: str = "text", most: int = KWIC_MOST) -> DataFrame:
    """(key, pos, left, match, right): the first `most` hits in text order, white space collapsed;
    pos is the hit's offset. Empty patterns and matches give no hit."""
    import re

    rx = re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", pattern) if literal else pattern
    rx = ("(?iu)" if ignore_case else "") + f"({rx})"
    n = max(CONTEXT_LEAST, min(CONTEXT_MOST, context))
    d = docs.where(F.col(text).rlike(rx)) if pattern else docs.limit(0)
    d = d.select(key, F.col(text).alias("x"), F.regexp_extract_all(F.col(text), F.lit(rx), F.lit(1)).alias("m"), F.split(F.col(text), rx, -1).alias("r"))
    start = F.aggregate(
        F.arrays_zip("m", F.slice("r", 1, F.size("m")).alias("r")),
        F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("at")),
        lambda a, z: F.struct((a["end"] + F.length(z["r"]) + F.length(z["m"])).alias("end"), F.concat(a["at"], F.array(a["end"] + F.length(z["r"]))).alias("at")),
    )
    h = d.select(key, "x", F.explode(F.arrays_zip("m", start["at"].alias("at"))).alias("h")).select(key, "x", F.col("h.m").alias("m"), F.col("h.at").alias("at")).where(F.length("m") > 0)
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    left = F.substr("x", F.greatest(F.col("at") - n, F.lit(0)) + 1, F.least(F.col("at"), F.lit(n)))
    right = F.substr("x", F.col("at") + F.length("m") + 1, F.lit(n))
    return h.orderBy(key, "at").limit(most).select(key, F.col("at").alias("pos"), flat(left).alias("left"), flat(F.col("m")).alias("match"), flat(right).alias("right"))


def sentence_around(text: Column, at: Column, length: Column) -> Column:
    """The sentence that holds the span: from behind the last end mark or line end to the next
    one, end mark included."""
    head = F.regexp_extract(F.substr(text, F.lit(1), at), r"([^.?!\n]*)$", 1)
    tail = F.regexp_extract(F.substr(text, at + length + 1), r"^([^.?!\n]*[.?!]?)", 1)
    return F.trim(F.concat(head, F.substr(text, at + 1, length), tail))


def auto_gloss(token: Column) -> Column:
    """Array of stem-GLOSS-GLOSS: suffixes peeled from the right, up to twelve, longest first;
    ambiguous ones give every combination, the first is the default. Null and blank: empty."""
    tok = t.strip(F.coalesce(token, F.lit("")))
    p = t.delimiter_parts(tok)
    suffix = t.casefold(t.strip(p["suffix"]))
    run = F.regexp_extract(F.reverse(suffix), rf"^((?:{GLOSS_ANY}){{0,12}})", 1)
    pieces = F.regexp_extract_all(run, F.lit(f"({GLOSS_ANY})"), F.lit(1))

    def gloss(x: Column) -> Column:
        out = F.lit("")
        for n, shape, g in reversed(GLOSSES):
            out = F.when((F.length(x) == n) & x.rlike(f"^{backwards(shape)}$"), g).otherwise(out)
        return F.split(out, r"\|")

    left = F.length(suffix) - F.length(run)
    bare = t.strip(F.left(t.strip(p["suffix"]), left))
    stem = F.coalesce(F.nullif(t.strip(p["stem"]), F.lit("")), F.nullif(bare, F.lit("")), tok)
    chain = F.reverse(F.transform(pieces, gloss))
    all_ = F.aggregate(chain, F.array(stem), lambda acc, gs: F.flatten(F.transform(acc, lambda a: F.transform(gs, lambda g: F.concat(a, F.lit("-"), g)))))
    return F.when((tok == "") | (run == ""), F.array().cast("array<string>")).otherwise(F.array_distinct(all_))


def merge_runs(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """rows with each run (keys, first, last, label, gloss) of adjacent tokens made one row, the
    tokens joined; runs of one row or that hold a meta row or a gap change nothing."""
    r = F.broadcast(runs) if runs.isLocal() else runs
    j = rows.join(r.select(*KEYS, "first", "last", F.col("label").alias("m_label"), F.col("gloss").alias("m_gloss")), list(KEYS), "left")
    inside = F.coalesce(F.col("ridx").between(F.col("first"), F.col("last")), F.lit(False))
    w = Window.partitionBy(*KEYS, F.when(inside, F.col("first")))
    j = j.withColumn("inside", inside).withColumn("n", F.count("*").over(w)).withColumn("metas", F.max(t.is_meta(F.col("token")).cast("int")).over(w))
    good = F.col("inside") & (F.col("n") >= 2) & (F.col("n") == F.col("last") - F.col("first") + 1) & (F.col("metas") == 0)
    j = j.withColumn("good", good)
    same = j.where(~F.col("good")).select(*KEYS, "ridx", "token", "label", "gloss")
    joined = j.where("good").groupBy(*KEYS, "first").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ridx", "token"))), lambda x: x["token"]), "").alias("token"), F.any_value("m_label").alias("label"), F.any_value("m_gloss").alias("gloss"))
    return same.unionByName(joined.select(*KEYS, F.col("first").alias("ridx"), "token", "label", "gloss"))


def relabel(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """rows with edits (keys, ridx, label, gloss) put in; nulls leave a cell. MatrixLang and
    EmbedLang rows take only TR or EN. Tokens that were edited count as reviewed."""
    e = edits.select(*KEYS, "ridx", F.col("label").alias("e_label"), F.col("gloss").alias("e_gloss"), F.lit(True).alias("edited"))
    j = rows.join(e, [*KEYS, "ridx"], "left")
    locked = t.strip(F.col("token")).isin("MatrixLang", "EmbedLang") & ~F.col("e_label").isin("TR", "EN")
    lab = F.when(F.coalesce(locked, F.lit(False)), F.col("label")).otherwise(F.coalesce("e_label", "label"))
    done = F.coalesce("edited", F.lit(False)) & ~t.is_meta(F.col("token"))
    return j.withColumns({"label": lab, "gloss": F.coalesce("e_gloss", "gloss"), "reviewed": done | F.coalesce(F.col("reviewed"), F.lit(False)) if "reviewed" in rows.columns else done}).drop("e_label", "e_gloss", "edited")


def revote(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """rows with MatrixLang and EmbedLang voted anew in the changed sentences (keys)."""
    from kilim.operators.labeling import vote

    matrix, embed = vote(F.when(~t.is_meta(F.col("token")), t.strip(F.col("label"))))
    v = rows.join(changed.select(*KEYS).distinct(), list(KEYS), "left_semi").groupBy(*KEYS).agg(matrix.alias("v_m"), embed.alias("v_e"))
    j = rows.join(v, list(KEYS), "left")
    tok = t.strip(F.col("token"))
    lab = F.when((tok == "MatrixLang") & F.col("v_m").isNotNull(), F.col("v_m")).when((tok == "EmbedLang") & F.col("v_e").isNotNull(), F.col("v_e")).otherwise(F.col("label"))
    return j.withColumn("label", lab).drop("v_m", "v_e")


def close_gaps(rows: DataFrame) -> DataFrame:
    """rows with bidx and ridx numbered anew without gaps, sentence by sentence."""
    blocks = rows.select(*KEYS).distinct().withColumn("__b", F.row_number().over(Window.partitionBy("dataset_id").orderBy("bidx")) - 1)
    r = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*KEYS).orderBy("ridx")) - 1).join(blocks, list(KEYS))
    return r.withColumn("bidx", F.col("__b")).withColumn("ridx", F.col("__r")).drop("__b", "__r")


def delete_rows(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows without those of (keys, ridx); a sentence left without rows goes; numbers close up."""
    return close_gaps(rows.join(keys.select(*KEYS, "ridx"), [*KEYS, "ridx"], "left_anti"))


def insert_before(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows with a blank row before each of (keys, ridx)."""
    new = keys.select(*KEYS, (F.col("ridx") - 0.5).alias("ridx"))
    cols = [c for c in rows.columns if c not in (*KEYS, "ridx")]
    blank = new.select(*KEYS, "ridx", *[F.lit("" if c in ("token", "label", "gloss") else None).cast(rows.schema[c].dataType).alias(c) for c in cols])
    r = rows.select(*KEYS, F.col("ridx").cast("double").alias("ridx"), *cols).unionByName(blank)
    return r.withColumn("ridx", F.row_number().over(Window.partitionBy(*KEYS).orderBy("ridx")) - 1)


def next_name(names: DataFrame, name: str = "name") -> DataFrame:
    """(next_name): Data N with N one above the highest in use."""
    n = F.try_to_number(F.nullif(F.regexp_extract(F.col(name), r"^\s*Data (\d{1,9})\s*$", 1), F.lit("")), F.lit("999999999")).cast("long")
    return names.agg(F.concat(F.lit("Data "), (F.coalesce(F.max(n), F.lit(0)) + 1).cast("string")).alias("next_name"))


CELLS = ("token", "label", "gloss")


def apply_cells(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """rows with pasted or cleared cells (keys, ridx, col, value; col 1 to 3 for token, label and
    gloss) put in; the number column 0 is protected, a null value clears, and MatrixLang and
    EmbedLang rows take only TR or EN as label. Of several values for a cell the greatest counts."""
    c = cells.where(F.col("col").isin(1, 2, 3)).withColumn("value", F.coalesce("value", F.lit("")))
    wide = c.groupBy(*KEYS, "ridx").agg(*[F.max(F.when(F.col("col") == i, F.col("value"))).alias(f"__{n}") for i, n in enumerate(CELLS, start=1)])
    j = rows.join(wide, [*KEYS, "ridx"], "left")
    locked = t.strip(F.col("token")).isin("MatrixLang", "EmbedLang") & ~F.coalesce(F.col("__label").isin("TR", "EN"), F.lit(False))
    label = F.when(F.coalesce(locked, F.lit(False)), F.col("label")).otherwise(F.coalesce("__label", "label"))
    return j.withColumns({"label": label, "token": F.coalesce("__token", "token"), "gloss": F.coalesce("__gloss", "gloss")}).drop(*[f"__{n}" for n in CELLS])


def add_column(rows: DataFrame, name: str, extras: str = "extras") -> DataFrame:
    """rows with an empty column `name` in the map of extra columns; blank names, names with a
    tab or line end, and names in use raise."""
    known = {"idx", *CELLS}
    if not name.strip() or any(c in name for c in "\t\r\n"):
        raise ValueError(f"not a column name: {name!r}")
    if name.strip() in known:
        raise ValueError(f"column exists: {name!r}")
    old = F.coalesce(F.col(extras), F.create_map().cast("map<string,string>")) if extras in rows.columns else F.create_map().cast("map<string,string>")
    new = F.when(F.map_contains_key(old, name.strip()), F.raise_error(F.lit(f"column exists: {name.strip()}")).cast("map<string,string>")).otherwise(F.map_concat(old, F.create_map(F.lit(name.strip()), F.lit(""))))
    return rows.withColumn(extras, new)


def correct_segmentation(rows: DataFrame, corrections: DataFrame) -> DataFrame:
    """rows with `segmentation` (root, segments, source, success) from corrections (token, root,
    text), applied to all occurrences of the token in its compared form; a correction that
    doesn't give the token back is marked as no success. Rows without one keep what they have."""
    form = t.match_form(F.col("token"))
    seg = t.manual_segments(F.coalesce("text", F.lit("")), F.col("token"))
    c = corrections.select(form.alias("__f"), F.struct(seg["root"].alias("root"), seg["segments"].alias("segments"), F.lit("manual").alias("source"), seg["success"].alias("success")).alias("__s")).groupBy("__f").agg(F.max_by("__s", F.to_json("__s")).alias("__s"))
    j = rows.withColumn("__f", form).join(c, "__f", "left")
    old = F.col("segmentation") if "segmentation" in rows.columns else F.lit(None).cast("struct<root:string,segments:array<string>,source:string,success:boolean>")
    return j.withColumn("segmentation", F.coalesce("__s", old)).drop("__f", "__s")


def undo(rows: DataFrame, log: DataFrame) -> DataFrame:
    """rows with the state before the last edit of each row in log (keys, ridx, n, label, gloss)."""
    last = log.groupBy(*KEYS, "ridx").agg(F.max_by(F.struct("label", "gloss"), "n").alias("__u"))
    j = rows.join(last, [*KEYS, "ridx"], "left")
    hit = F.col("__u").isNotNull()
    return j.withColumns({"label": F.when(hit, F.col("__u.label")).otherwise(F.col("label")), "gloss": F.when(hit, F.col("__u.gloss")).otherwise(F.col("gloss"))}).drop("__u")


def complete_votes(rows: DataFrame) -> DataFrame:
    """rows with a MatrixLang row, by plain counts of TR and EN, before the EmbedLang row of
    sentences that have the latter but not the former."""
    tok, lab = t.strip(F.col("token")), t.strip(F.col("label"))
    n = lambda c: F.count(F.when(c, 1))
    g = rows.groupBy(*KEYS).agg(n(tok == "MatrixLang").alias("m"), F.min(F.when(tok == "EmbedLang", F.col("ridx"))).alias("at"), n((lab == "TR") & ~t.is_meta(F.col("token"))).alias("tr"), n((lab == "EN") & ~t.is_meta(F.col("token"))).alias("en"))
    lacking = g.where("m = 0 and at is not null").select(*KEYS, F.col("at").alias("ridx"), F.when(F.col("tr") >= F.col("en"), "TR").otherwise("EN").alias("__v"))
    with_blank = insert_before(rows, lacking)
    j = with_blank.join(lacking, [*KEYS, "ridx"], "left")
    hit = F.col("__v").isNotNull() & (F.col("token") == "")
    return j.withColumns({"token": F.when(hit, "MatrixLang").otherwise(F.col("token")), "label": F.when(hit, F.col("__v")).otherwise(F.col("label"))}).drop("__v")
