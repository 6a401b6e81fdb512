"""Cross-references and variant readings written in document markup.

Parsing is by column expressions: matches come out of `regexp_extract_all` together with the text
between them, so every match has its position without any Python. Brackets are short; documents are
cut into them first and only bracket rows are grouped again.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vidimus.functions import text as tx
from vidimus.functions.frames import cut_lineage
from vidimus.operators.spans import resolve_numbers

# The shapes of the markup and of a reference list.
DOC_NUMBER = r"(?s)<cb:docNumber>(.*?)</cb:docNumber>"
BRACKET = r"\[([^\]]*)\]"
SELF_NUMBER = r"(?U)^No\.\s*(\d+[A-Za-z]?)"
CF = r"(?iU)\bcf\."
PART_OF = r"(?iU)\bpart\s+of\b"
RANGE = r"\d+\s*[-–]\s*\d+"
SINGLE = r"\d+[A-Za-z]?\s*(?:\([^)]*\))?"
TOKEN = f"(?sU){RANGE}|{SINGLE}"  # of a range, not its first number
RANGE_HEAD = r"(?U)^\d+\s*[-–]"  # a single number is followed by a letter, space or parenthesis
NESTED = r"(?U)\([^)]*\d\s*[-–]\s*\d"
RESIDUE = r"(?iU)^(?:Nos?\.|cf\.|Part\s+of|Fasc\.|and|etc\.|[\s,;:.&–-])+$"
MAX_RANGE = 200
APP = r"(?s)<app\b([^>]*)>(.*?)</app>"
READING = r"(?s)<(lem|rdg)\b([^>]*)>(.*?)</\1>"
SIGLUM = r"【[^】]*】"
NOTE_CF = r'<note\b[^>]*\btype="(cf[^"]*)"'
EDITORIAL_SIGLUM = "【CB"
EDITORIAL_RESP = "CBETA"

BUCKETS = ("asserted", "compare_only", "part_of", "unparsed")


def matches(text: Column, pattern: str) -> Column:
    """All matches left to right with 0-based bounds: array of (start, end, tok)."""
    split = f"(?sU)(.*?)({pattern}|$)"
    gaps = F.regexp_extract_all(text, F.lit(split), F.lit(1))
    toks = F.regexp_extract_all(text, F.lit(split), F.lit(2))
    empty = F.array().cast("array<struct<start:int,end:int,tok:string>>")
    step = F.zip_with(gaps, toks, lambda g, t: F.struct(F.length(g).alias("gap"), t.alias("tok")))

    def add(acc: Column, s: Column) -> Column:
        at = acc["at"] + s["gap"]
        end = at + F.length(s["tok"])
        hit = F.struct(at.alias("start"), end.alias("end"), s["tok"].alias("tok"))
        return F.struct(end.alias("at"), F.when(s["tok"] != "", F.concat(acc["got"], F.array(hit))).otherwise(acc["got"]).alias("got"))

    return F.aggregate(step, F.struct(F.lit(0).alias("at"), empty.alias("got")), add, lambda acc: acc["got"])


def _range_ends(tok: Column) -> tuple[Column, Column]:
    return (
        F.regexp_extract(tok, r"(?U)^(\d+)", 1).try_cast("bigint"), F.regexp_extract(tok, r"(?U)(\d+)$", 1).try_cast("bigint"),
    )


def _with_refs(df: DataFrame, segment: str, out: str) -> DataFrame:
    """Read one half of a bracket into `out` (array of number, sub_ref) and `out_clean`.

    Chunks between semicolons that hold no digit are annotations and dropped. A descending or too wide
    range, or anything left over that is no separator, makes the half unclean.

    A range inside parentheses may lie in the match of a single number, so such halves are matched twice and
    cut by bounds. Elsewhere ranges and singles do not overlap, and one pass over the text finds both: the
    matches differ only where a parenthesis follows a range, which either way is left over."""
    seg, rng, one, tok = f"_{out}_seg", f"_{out}_rng", f"_{out}_one", f"_{out}_tok"
    chunks = F.filter(F.split(segment, ";"), lambda c: c.rlike(r"(?U)\d"))
    df = df.withColumn(seg, F.array_join(chunks, "; "))
    nested = F.col(seg).rlike(NESTED)
    df = df.withColumn(rng, F.when(nested, matches(F.col(seg), RANGE)))
    inside = lambda s: F.exists(F.col(rng), lambda r: (r["start"] <= s["start"]) & (s["start"] < r["end"]))
    df = df.withColumn(one, F.when(nested, F.array_sort(F.concat(rng, F.filter(matches(F.col(seg), SINGLE), lambda s: ~inside(s))))))
    in_order = F.transform(F.col(one), lambda s: s["tok"])
    df = df.withColumn(tok, F.when(F.col(one).isNotNull(), in_order).otherwise(F.regexp_extract_all(seg, F.lit(TOKEN), F.lit(0))))
    is_range = lambda t: t.rlike(RANGE_HEAD)
    bad = F.exists(F.col(tok), lambda t: is_range(t) & ~F.coalesce(
        (_range_ends(t)[1] >= _range_ends(t)[0]) & (_range_ends(t)[1] - _range_ends(t)[0] <= MAX_RANGE), F.lit(False)))
    # matches are cut out from the last to the first, by the bounds they had in the whole segment
    by_bounds = F.aggregate(
        F.reverse(F.col(one)), F.col(seg),
        lambda acc, s: F.concat(F.substring(acc, F.lit(1), s["start"]), F.substring(acc, s["end"] + 1, F.lit(1 << 30))),
    )
    rest = F.when(F.col(one).isNotNull(), by_bounds).otherwise(F.regexp_replace(seg, TOKEN, ""))
    df = df.withColumn(f"_{out}_bad", bad).withColumn(f"_{out}_rest", F.when(~F.col(f"_{out}_bad"), rest))
    clean = ~F.col(f"_{out}_bad") & ((tx.strip_space(f"_{out}_rest") == "") | F.col(f"_{out}_rest").rlike(RESIDUE))
    none = F.lit(None).cast("string")
    sub = lambda t: F.when(F.contains(t, F.lit("(")), F.nullif(tx.strip_space(F.regexp_extract(t, r"\(([^)]*)\)", 1)), F.lit("")))
    single = lambda t: F.array(F.struct(F.regexp_extract(t, r"(?U)^(\d+[A-Za-z]?)", 1).alias("number"), sub(t).alias("sub_ref")))
    many = lambda t: F.transform(
        F.sequence(*_range_ends(t)), lambda n: F.struct(n.cast("string").alias("number"), none.alias("sub_ref"))
    )
    df = df.withColumn(f"{out}_clean", clean)
    refs = F.flatten(F.transform(F.col(tok), lambda t: F.when(is_range(t), many(t)).otherwise(single(t))))
    empty = F.array().cast("array<struct<number:string,sub_ref:string>>")
    return df.withColumn(out, F.when(F.col(f"{out}_clean"), refs).otherwise(empty))


def doc_numbers(docs: DataFrame) -> DataFrame:
    """Every number element of a document with tags removed, in order."""
    raw = docs.select("doc", F.posexplode(F.regexp_extract_all("body", F.lit(DOC_NUMBER), F.lit(1))).alias("elem", "raw"))
    return raw.select("doc", "elem", tx.strip_markup("raw").alias("clean"))


def self_numbers(docs: DataFrame) -> DataFrame:
    """A document's own number: the first element that opens with one."""
    own = doc_numbers(docs).select("doc", "elem", F.regexp_extract("clean", SELF_NUMBER, 1).alias("number")).filter("number <> ''")
    return own.groupBy("doc").agg(F.min_by("number", "elem").alias("self_number"))


def extract_refs(docs: DataFrame) -> DataFrame:
    """References in the number elements of every document (X1): `doc, bucket, ord, number, sub_ref`.

    What precedes the first "cf." of a bracket is asserted (or part_of), what follows is compare_only. A
    bracket that is not read cleanly is declined whole and kept verbatim under `unparsed`. Repeats of a
    reference in one bucket of a document are dropped, first place kept.
    """
    el = doc_numbers(docs).repartition("doc")  # the only shuffle: repeats and places are found within a document
    br = el.select("doc", "elem", F.posexplode(F.regexp_extract_all("clean", F.lit(BRACKET), F.lit(1))).alias("br", "b"))
    br = br.select("doc", "elem", "br", tx.strip_space("b").alias("bracket")).filter("bracket <> ''")
    br = br.withColumn("inside", F.col("bracket").rlike(PART_OF))
    head = F.regexp_extract("bracket", r"(?siU)^(.*?)(?:\bcf\.|$)", 1)
    tail = F.regexp_extract("bracket", r"(?siU)\bcf\.(.*)$", 1)
    br = br.withColumn("head", F.when(F.col("inside"), F.regexp_replace(head, PART_OF, "")).otherwise(head)).withColumn("tail", tail)
    br = _with_refs(_with_refs(br, "head", "front"), "tail", "back")
    ok = F.col("front_clean") & (F.col("back_clean") | (tx.strip_space("tail") == ""))
    br = br.withColumn("_ok", ok)
    tag = lambda bucket, part: lambda r, i: F.struct(bucket.alias("bucket"), F.lit(part).alias("part"), i.alias("i"), r["number"].alias("number"), r["sub_ref"].alias("sub_ref"))
    front = F.transform("front", tag(F.when(F.col("inside"), F.lit("part_of")).otherwise(F.lit("asserted")), 0))
    back = F.transform("back", tag(F.lit("compare_only"), 1))
    declined = F.array(F.struct(F.lit("unparsed").alias("bucket"), F.lit(0).alias("part"), F.lit(0).alias("i"), F.col("bracket").alias("number"), F.lit(None).cast("string").alias("sub_ref")))
    rows = br.select("doc", "elem", "br", F.explode(F.when(F.col("_ok"), F.concat(front, back)).otherwise(declined)).alias("r")).select("doc", "elem", "br", "r.*")
    # declined brackets are not deduplicated, so their place keeps them apart
    apart = F.when(F.col("bucket") == "unparsed", F.struct("elem", "br"))
    one = rows.withColumn("_apart", apart).groupBy("doc", "bucket", "number", "sub_ref", "_apart").agg(F.min(F.struct("elem", "br", "part", "i")).alias("at"))
    w = Window.partitionBy("doc", "bucket").orderBy("at")
    return one.select("doc", "bucket", (F.row_number().over(w) - 1).alias("ord"), "number", "sub_ref")


def catalogue_of(entries: DataFrame, column: str = "entry_path") -> DataFrame:
    """Bare numbers and references of the T entries of an archive listing."""
    ref = F.regexp_extract(tx.file_name(column), tx.T_REF_RE, 1)
    return entries.select(tx.t_number(column).alias("number"), ref.alias("ref")).filter("number IS NOT NULL").distinct()


def resolve_refs(refs: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Asserted references with their candidates; each distinct number is resolved once."""
    asserted = refs.filter("bucket = 'asserted'")
    return asserted.join(resolve_numbers(asserted, catalogue), "number")


def resolve_counts(refs: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Asserted numbers with how often they are referred to (`n`) and their candidates, a row a number.

    References are counted before anything is joined, and the result is written once."""
    asserted = cut_lineage(refs.filter("bucket = 'asserted'").groupBy("number").agg(F.count(F.lit(1)).alias("n")))
    return cut_lineage(asserted.join(resolve_numbers(asserted, catalogue), "number"))


def _by_number(resolved: DataFrame) -> DataFrame:
    """(number, outcome, n) of the rows of `resolve_refs` or `resolve_counts`."""
    n = F.sum("n") if "n" in resolved.columns else F.count(F.lit(1))
    return resolved.groupBy("number", "outcome").agg(n.alias("n"))


def scan_tallies(docs: DataFrame, refs: DataFrame, resolved: DataFrame) -> DataFrame:
    """What a corpus scan found: `measure, value, n` (X2). `resolved` is of `resolve_refs` or `resolve_counts`."""
    per = refs.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    row = lambda df, m, v, n: df.select(F.lit(m).alias("measure"), v.cast("string").alias("value"), n.cast("bigint").alias("n"))
    out = row(per, "references", F.col("bucket"), F.col("n"))
    out = out.unionByName(row(docs.agg(F.count(F.lit(1)).alias("n")), "entries", F.lit("read"), F.col("n")))
    out = out.unionByName(row(refs.agg(F.count_distinct("doc").alias("n")), "entries", F.lit("with references"), F.col("n")))
    numbers = _by_number(resolved)
    by = numbers.groupBy("outcome").agg(F.sum("n").alias("n"))
    out = out.unionByName(row(by, "resolution", F.col("outcome"), F.col("n")))
    distinct = numbers.filter("outcome <> 'resolved'").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    out = out.unionByName(row(distinct, "distinct numbers", F.col("outcome"), F.col("n")))
    notes = docs.select(F.explode(F.regexp_extract_all("body", F.lit(NOTE_CF), F.lit(1))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    return out.unionByName(row(notes, "note type", F.col("t"), F.col("n")))


def most_often(resolved: DataFrame, outcome: str, k: int = 10) -> DataFrame:
    """The numbers most often left unresolved for one reason (X2). `resolved` as in `scan_tallies`."""
    n = _by_number(resolved.filter(F.col("outcome") == outcome)).select("number", "n")
    return n.orderBy(F.desc("n"), "number").limit(k)


def declined_brackets(refs: DataFrame) -> DataFrame:
    """Declined brackets with how often and one example document."""
    return refs.filter("bucket = 'unparsed'").groupBy(F.col("number").alias("bracket")).agg(
        F.count(F.lit(1)).alias("n"), F.min("doc").alias("example")
    )


def reference_map(refs: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row per document: its buckets in order and the references resolved one to one."""
    entry = F.struct("ord", "number", "sub_ref")
    bucket = lambda b: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("bucket") == b, entry))),
        lambda e: F.struct(e["number"].alias("number"), e["sub_ref"].alias("sub_ref")),
    ).alias(b)
    rows = refs.groupBy("doc").agg(*[bucket(b) for b in BUCKETS])
    hits = resolved.filter("outcome = 'resolved'").groupBy("doc").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col("candidates")[0].alias("ref")))), lambda e: e["ref"]).alias("resolved_refs")
    )
    return rows.join(hits, "doc", "left").withColumn("resolved_refs", F.coalesce("resolved_refs", F.array().cast("array<string>")))


# --- apparatus ------------------------------------------------------------------------------------------
def _attr(raw: str | Column, name: str) -> Column:
    raw = F.col(raw) if isinstance(raw, str) else raw
    # the last one written counts
    return F.try_element_at(F.regexp_extract_all(raw, F.lit(rf'(?<![\w:.-]){name}\s*=\s*"([^"]*)"'), F.lit(1)), F.lit(-1))


def _sigla(wit: Column) -> Column:
    wit = F.coalesce(wit, F.lit(""))
    found = F.regexp_extract_all(wit, F.lit(SIGLUM), F.lit(0))
    return F.when(F.size(found) > 0, found).otherwise(F.filter(F.split(wit, r"(?U)\s+"), lambda s: s != ""))


def extract_apparatus(docs: DataFrame) -> DataFrame:
    """Readings of every apparatus entry (X3): `doc, app, n, ord, kind, sigla, text, resp`.

    The first lemma is the adopted reading; everything after is a variant. Joint sigla stay one group.
    An entry without readings has one row with a null kind."""
    grab = lambda c, p, g: F.regexp_extract_all(c, F.lit(p), F.lit(g))
    apps = docs.select("doc", F.posexplode(F.arrays_zip(grab("body", APP, 1).alias("attrs"), grab("body", APP, 2).alias("inner"))).alias("app", "a"))
    apps = apps.select("doc", "app", _attr(F.col("a.attrs"), "n").alias("n"), F.col("a.inner").alias("inner"))
    parts = F.arrays_zip(grab("inner", READING, 1).alias("tag"), grab("inner", READING, 2).alias("attrs"), grab("inner", READING, 3).alias("raw"))
    rows = apps.select("doc", "app", "n", grab("inner", READING, 1).alias("tags"), F.posexplode_outer(parts).alias("ord", "r"))
    lemma = F.array_position("tags", "lem") - 1
    kind = F.when(F.col("r").isNull(), F.lit(None)).when(F.col("ord") == lemma, "lemma").otherwise("variant")
    return rows.select(
        "doc", "app", "n", "ord", kind.alias("kind"), F.when(F.col("r").isNotNull(), _sigla(_attr(F.col("r.attrs"), "wit"))).alias("sigla"),
        tx.strip_markup("r.raw").alias("text"), _attr(F.col("r.attrs"), "resp").alias("resp"),
    )


def edition_families(app: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How often each group of editions is cited, the group taken as written."""
    cited = app.filter(F.size("sigla") > 0).withColumn("family", F.array_join("sigla", " "))
    return cited.groupBy(*(by or []), "family").agg(F.count(F.lit(1)).alias("n"))


def collate(witnesses: DataFrame, app: DataFrame) -> DataFrame:
    """Collation record of each witness.

    `witnesses` holds `witness_id, doc`, doc null when no passage leads back to a source. No source and
    no apparatus are indeterminate; otherwise the check passes at the edition-support rung."""
    entries = app.groupBy("doc").agg(F.count_distinct("app").alias("entries"))
    fam = edition_families(app, ["doc"])
    listed = fam.groupBy("doc").agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("_n"), "family"))),
            lambda e: F.concat(e["family"], F.lit(" x"), (-e["_n"]).cast("string")),
        ), "; ").alias("families"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.contains("family", F.lit(" ")), F.col("family")))), ", ").alias("joint_groups"),
    )
    editorial = F.exists("sigla", lambda s: s.startswith(EDITORIAL_SIGLUM)) | F.startswith(F.upper(F.coalesce("resp", F.lit(""))), F.lit(EDITORIAL_RESP))
    ed = app.filter((F.col("kind") == "lemma") & editorial).groupBy("doc").agg(F.count(F.lit(1)).alias("editorial_lemmas"))
    j = witnesses
    for part in (entries, listed, ed):
        j = j.join(part, "doc", "left")
    ok = F.col("entries").isNotNull()
    return j.select(
        "witness_id", F.lit("cross_edition_collation").alias("method"), F.when(ok, "pass").otherwise("indeterminate").alias("result"),
        F.when(ok, "A3_EDITION_SUPPORT_CHECKED").otherwise("A0_UNCHECKED").alias("assurance_level"),
        F.when(F.col("doc").isNull(), "no source").when(~ok, "no apparatus").otherwise("collated").alias("finding"),
        F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("families", F.lit("")).alias("families"),
        F.coalesce("joint_groups", F.lit("")).alias("joint_groups"), F.coalesce("editorial_lemmas", F.lit(0)).alias("editorial_lemmas"),
    )


# --- linking ----------------------------------------------------------------------------------------------
def witness_source(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Any source reference of each witness: that of its first passage that has one."""
    refs = nodes.filter("type = 'passage'").select(F.col("id").alias("src"), F.get_json_object("payload", "$.source_ref").alias("source_ref")).filter("coalesce(source_ref, '') <> ''")
    link = edges.filter("type = 'part_of' AND retracted_at IS NULL").select("src", F.col("dst").alias("witness_id"), "created_seq")
    return link.join(refs, "src").groupBy("witness_id").agg(F.min_by("source_ref", F.struct("created_seq", "src")).alias("source_ref"))


def link_parallels(nodes: DataFrame, edges: DataFrame, witnesses: DataFrame, refs: DataFrame, catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parallels the markup asserts between witnesses (X6): (new symmetric edges, report).

    `witnesses` holds `witness_id, doc`. The report has one row per reference with its bucket: linked,
    already_linked, absent_from_graph, unknown, ambiguous, self, or not asserted (compare_only, part_of,
    unparsed). A pair asserted from both sides becomes one edge."""
    mine = cut_lineage(refs.join(witnesses, "doc"))
    own = nodes.filter("type = 'witness'").select(F.col("id").alias("witness_id"), F.get_json_object("payload", "$.canonical_ref").alias("own_ref"))
    res = resolve_refs(mine, catalogue).join(own, "witness_id")
    target = F.concat(F.lit("witness:"), F.get("candidates", F.lit(0)))
    res = res.withColumn("target_id", F.when(F.col("outcome") == "resolved", target))
    here = nodes.select(F.col("id").alias("target_id")).withColumn("present", F.lit(True))
    drawn = edges.filter("type = 'parallel_of' AND retracted_at IS NULL").select(F.col("src").alias("witness_id"), F.col("dst").alias("target_id")).distinct().withColumn("drawn", F.lit(True))
    j = res.join(here, "target_id", "left").join(drawn, ["witness_id", "target_id"], "left")
    bucket = (
        F.when(F.col("outcome") != "resolved", F.col("outcome")).when(F.get("candidates", F.lit(0)) == F.col("own_ref"), "self")
        .when(F.col("present").isNull(), "absent_from_graph").when(F.col("drawn").isNotNull(), "already_linked").otherwise("linked")
    )
    asserted = cut_lineage(j.select("witness_id", "doc", bucket.alias("bucket"), "ord", "number", "sub_ref", "target_id"))
    fresh = asserted.filter("bucket = 'linked'").select(
        F.least("witness_id", "target_id").alias("a"), F.greatest("witness_id", "target_id").alias("b"), "witness_id", "ord", "number"
    )
    first = fresh.groupBy("a", "b").agg(F.min(F.struct("witness_id", "ord", "number")).alias("f"))
    settled = asserted.join(
        first.select("a", "b", F.col("f.witness_id").alias("w1"), F.col("f.ord").alias("o1")),
        (F.least("witness_id", "target_id") == F.col("a")) & (F.greatest("witness_id", "target_id") == F.col("b")), "left",
    )
    again = (F.col("bucket") == "linked") & ~((F.col("witness_id") == F.col("w1")) & (F.col("ord") == F.col("o1")))
    settled = settled.withColumn("bucket", F.when(again, "already_linked").otherwise(F.col("bucket"))).drop("a", "b", "w1", "o1")
    rest = mine.filter("bucket <> 'asserted'").select("witness_id", "doc", "bucket", "ord", "number", "sub_ref", F.lit(None).cast("string").alias("target_id"))
    new = settled.filter("bucket = 'linked'").select(
        F.concat(F.lit("edge:"), F.substring(F.sha2(F.concat_ws("\x1f", "witness_id", "target_id"), 256), 1, 32)).alias("id"),
        F.lit("parallel_of").alias("type"), F.col("witness_id").alias("src"), F.col("target_id").alias("dst"),
    )
    return new, settled.unionByName(rest)
