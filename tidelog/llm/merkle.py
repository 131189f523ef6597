"""Document fingerprints: a Merkle tree over paragraphs and sections.

Only DataFrame functions. A document is cut into paragraphs (lines, ended by a
newline; a line of more than ``PARAGRAPH`` code points is cut after the sentence ends
in it, and a sentence after every ``PARAGRAPH`` code points). Sections are runs of
paragraphs that end at a paragraph whose hash is divisible by ``SECTION``, so an edit
moves no section border but its own. The fingerprint is ``root:sections:paragraphs``
in hex: the root hashes the section hashes, a section hashes its paragraph hashes, a
paragraph hashes its text; sections are given as ``hash/paragraphs``.

Roots test equality. Where they differ, sections found in only one of two
fingerprints hold the edits, and in them the paragraphs found in only one.
Likeness is 1.0 for equal roots; else the tree is descended: sections that both have are
shared as they are, the others are opened, and what of their paragraphs the other lacks
is not shared. Twice the shared different paragraphs over those of each.

Defined results: null and empty text have one empty paragraph; repeated ids keep one
row each (neighbours by id, then text); rows with a null id come last; extra columns
are ignored; an empty table gives an empty result.

Scale: no pair of documents is compared but a document and its neighbour; the
neighbour comes from one shuffle by id range, whose border rows are sent twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import doc_texts, range_number

PARAGRAPH, SECTION = 200, 8
#: Rows aimed at in an id range, and the most ranges.
RANGE_ROWS, RANGES = 2000, 20_000


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, also where lambdas in it use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text; joined they give the text again."""

    def sentences(line: Column) -> Column:
        found = F.split(line, r"(?<=[.!?] )", -1)
        pieces = lambda y: F.when(F.char_length(y) <= PARAGRAPH, F.array(y)).otherwise(F.regexp_extract_all(y, F.lit(rf"(?s).{{1,{PARAGRAPH}}}"), F.lit(0)))
        return F.flatten(F.transform(found, pieces))

    def cut(lines: Column) -> Column:
        long = F.exists(lines, lambda x: F.char_length(x) > PARAGRAPH)
        parts = F.flatten(F.transform(lines, lambda x: F.when(F.char_length(x) <= PARAGRAPH, F.array(x)).otherwise(sentences(x))))
        return F.when(long, parts).otherwise(lines)

    found = F.filter(_let(F.split(text, r"(?<=\n)", -1), cut), lambda x: x != "")
    return _let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(F.lit(""))))


def leaves(text: Column) -> Column:
    """Hashes of the paragraphs, in order."""
    return F.transform(paragraphs(text), lambda p: F.xxhash64(p))


def _hex(h: Column) -> Column:
    return F.lpad(F.lower(F.hex(h)), 16, "0")


def branches(hashes: Column) -> Column:
    """The sections, each ``section/paragraphs,paragraph,...``, from the paragraphs' hashes."""
    return _let(hashes, _branches)  # lambdas in it use them for each section


def _branches(hashes: Column) -> Column:
    marked = F.transform(hashes, lambda h, i: F.when((F.pmod(h, F.lit(SECTION)) == 0) | (i == F.size(hashes) - 1), i + 1))

    def nodes(ends: Column) -> Column:
        def node(end: Column, k: Column) -> Column:
            start = F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1))
            named = lambda part: F.concat(_hex(F.xxhash64(part)), F.lit("/"), F.size(part).cast("string"))
            return _let(F.slice(hashes, start + 1, end - start), lambda part: F.concat_ws(",", named(part), F.transform(part, _hex)))

        return F.transform(ends, node)

    return _let(F.filter(marked, lambda i: i.isNotNull()), nodes)


def fingerprint(tree: Column) -> Column:
    """``root:section/paragraphs,...:paragraph,...`` from the branches."""
    sections = F.concat_ws(",", F.transform(tree, lambda s: F.substring_index(s, ",", 1)))
    below = F.concat_ws(",", F.transform(tree, lambda s: F.substr(s, F.instr(s, ",") + 1)))
    return _let(sections, lambda s: F.concat_ws(":", F.substring(F.sha2(s, 256), 1, 32), s, below))


def opened(tree: Column) -> Column:
    """The paragraphs of some branches, in order."""
    return F.flatten(F.transform(tree, lambda s: F.split(F.substr(s, F.instr(s, ",") + 1), ",", -1)))


def likeness(a: Column, b: Column, same_root: Column) -> Column:
    """Likeness of two trees (branches): only branches that the other lacks are opened."""
    theirs, of = opened(b), lambda t: F.size(F.array_distinct(opened(t)))
    both = lambda n: 2.0 * (n - F.size(F.array_except(opened(F.array_except(a, b)), theirs))) / (n + of(b))
    return F.when(same_root, F.lit(1.0)).otherwise(_let(of(a), both))


def located_edits(a: Column, b: Column) -> Column:
    """Paragraph numbers (from 0) of ``a``'s fingerprint that ``b``'s lacks: only the
    sections that ``b`` lacks are opened."""
    part = lambda f, i: F.split(F.element_at(F.split(f, ":", -1), i), ",", -1)
    sections, theirs = part(a, 2), part(b, 2)
    size = lambda s: F.element_at(F.split(s, "/"), 2).cast("int")
    spans = F.transform(sections, lambda s, i: F.struct(F.aggregate(F.slice(sections, 1, i), F.lit(0), lambda n, t: n + size(t)).alias("a"), size(s).alias("n"), F.array_contains(theirs, s).alias("same")))
    numbers = F.flatten(F.transform(F.filter(spans, lambda s: ~s["same"]), lambda s: F.sequence(s["a"], s["a"] + s["n"] - 1)))
    mine, others = part(a, 3), part(b, 3)
    return F.filter(numbers, lambda i: ~F.array_contains(others, F.element_at(mine, i + 1)))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and the next document's text by descending id (after the last: the first)."""
    texts = doc_texts(docs)
    n = docs.select("doc_id").count()
    ranges = min(RANGES, max(1, n // RANGE_ROWS))
    cuts = [i / ranges for i in range(1, ranges)] or [0.5]
    low = F.lit(-(2**63)).cast("long")
    key = F.coalesce(F.col("doc_id").cast("long"), low)
    # actual ids: each is the highest of its range, as is the highest of all
    found = docs.select(key.alias("key")).agg(F.percentile_approx("key", cuts, 100_000).alias("b"), F.max("key").alias("top")).first()
    bounds = sorted({*(found["b"] or [])[: ranges - 1], *([found["top"]] if n else [])})
    tops = docs.sparkSession.createDataFrame([(b, i) for i, b in enumerate(bounds)], "key long, nth int")
    ranged = texts.withColumn("key", key).withColumn("range", range_number(F.col("key"), bounds))
    # the top row of a range is also the row after the last one of the range above it; the highest follows the lowest
    ghost = F.when(F.col("nth").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    dealt = (
        ranged.join(F.broadcast(tops), "key", "left")
        .withColumn("ghost", F.explode(ghost))
        .withColumn("range", F.when(F.col("ghost") == 0, F.col("range")).otherwise(F.pmod(F.col("range") + 1, F.lit(max(1, len(bounds))))))
    )
    # the range above range r is r+1: its last rows are followed by the top row of r
    order = Window.partitionBy("range").orderBy("ghost", F.desc("key"), F.desc("text"))
    return dealt.withColumn("next", F.lead("text").over(order)).where("ghost = 0").select("doc_id", "text", "next")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text (second half from the next)."""
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 2) as int))"), F.substring(F.col("next"), F.lit(1), half))
    pairs = with_next(docs).withColumn("next", F.coalesce("next", F.lit(""))).withColumn("edited", edited)
    trees = pairs.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), *[branches(leaves(F.col(c))).alias(t) for c, t in (("text", "h"), ("edited", "e"), ("next", "x"))])
    rooted = trees.select("*", *[fingerprint(F.col(c)).alias(f"{c}_print") for c in "hex"])
    same = lambda c: F.substring_index("h_print", ":", 1) == F.substring_index(f"{c}_print", ":", 1)
    return rooted.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.col("h_print").alias("fingerprint"),
        F.col("e_print").alias("edited_fingerprint"),
        likeness(F.col("h"), F.col("e"), same("e")).alias("near_edited"),
        likeness(F.col("h"), F.col("x"), same("x")).alias("near_next"),
    )
