"""Document fingerprints by closed syncmers, in DataFrame functions alone.

Method
  A text is its UTF-8 bytes behind K - 1 zero bytes. A k-mer (K bytes) is a closed
  syncmer, here an anchor, if the smallest of its inner substrings of S bytes is
  its first or its last; substrings are ordered by a 64-bit hash, those of the zero
  bytes in front before all others, so that the k-mers over the start of a text are
  anchors too. Whether a k-mer is one depends on its own bytes only: an edit moves
  no anchor beyond K bytes of it, and what stands before or behind doesn't matter.

  The fingerprint deals all anchors to CELLS cells by their hash and keeps the
  smallest of each cell with the place where it stands first. Cells that agree,
  as a share of those filled on either side, estimate the Jaccard likeness of the
  two sets of anchors; the places of those that agree tell how far text has moved.

Layout for scale
  Ids, not texts, are read to cut the order of documents into ranges. One
  exchange then moves each text once; the next document, both fingerprints and
  their likeness are found inside the ranges. The first row of a range is also sent to the one before.
  Hashes are computed in generated code, eight places a row: each substring is
  hashed twice at most, and the edited text only where it differs from the first.
  State is CELLS numbers a document, whatever its length.

Defined results
  Null texts are empty ones; an empty text has no anchors and the fingerprint ''.
  Documents follow one another by id (null first), then text; the last one's next
  is the first, and a document alone is its own. Rows that repeat an id follow
  one another like any others. Two empty fingerprints are alike (1.0), an empty and
  another are not (0.0). An empty table gives an empty one. Columns but doc_id and
  text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import reducers

C = F.col
#: Bytes of an anchor, bytes of its inner substrings, cells of a fingerprint.
K, S, CELLS = 24, 17, 64
#: Inner substrings of an anchor, and places that one generated row looks at.
INNER, STRIDE = K - S + 1, 8
PAD = bytes(K - 1)


def _ranges(docs: DataFrame, n: int) -> tuple[list[int], dict[int, int | None]]:
    """Bounds of up to ``n`` ranges of ids, and the first id of each range that has rows.

    Both are as many numbers as ranges at most.
    """
    cuts = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10_000)).first()[0] if n > 1 else None
    bounds = sorted(set(cuts or []))
    firsts = docs.groupBy(_range_of(bounds).alias("r")).agg(F.min("doc_id").alias("id"), F.count_if(C("doc_id").isNull()).alias("nulls")).collect()
    return bounds, {r.r: None if r.nulls else r.id for r in firsts}


def _range_of(bounds: list[int]) -> Column:
    """Number of bounds that are not above doc_id: counted in heads, then behind one head."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    upto = lambda xs: F.size(F.filter(xs, lambda x: x <= C("doc_id")))
    literal = lambda xs: F.lit(xs)
    head = upto(literal(bounds[::step]))
    found = (head - 1) * step + upto(F.slice(literal(bounds), (head - 1) * step + 1, step))
    return F.coalesce(F.when(head > 0, found), F.lit(0))


def in_order(docs: DataFrame) -> DataFrame:
    """range, place, edge, doc_id, text and the text of the next document.

    Rows of a range lie in one partition. Rows with ``edge`` are copies of the
    first rows of the following range: they are there to be the next one of others.
    """
    docs = docs.select(C("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds, firsts = _ranges(docs, reducers(docs.sparkSession))
    own = _range_of(bounds)
    if not firsts:
        return docs.select(F.lit(0).alias("range"), F.lit(0).alias("place"), F.lit(False).alias("edge"), "doc_id", "text", C("text").alias("next_text"))
    order = sorted(firsts)
    before = [(firsts[r], order[k - 1]) for k, r in enumerate(order)]  # the last range is before the first
    known = {i: r for i, r in before if i is not None}
    back = F.when(C("doc_id").isNull(), F.lit(order[-1]))
    if known:
        back = F.coalesce(back, F.element_at(F.create_map(*[x for i, r in known.items() for x in (F.lit(i).cast("long"), F.lit(r))]), C("doc_id")))
    places = F.when(back.isNull(), F.array(F.struct(own.alias("range"), F.lit(False).alias("edge")))).otherwise(F.array(F.struct(own.alias("range"), F.lit(False).alias("edge")), F.struct(back.alias("range"), F.lit(True).alias("edge"))))
    rows = docs.select("doc_id", "text", F.explode(places).alias("_p")).select("_p.range", "_p.edge", "doc_id", "text")
    w = Window.partitionBy("range").orderBy("edge", "doc_id", "text")
    return rows.select("range", F.row_number().over(w).alias("place"), "edge", "doc_id", "text", F.lead("text").over(w).alias("next_text"))


def anchors(texts: DataFrame, keys: list[str], data: str = "data", shift: str | None = None) -> DataFrame:
    """``keys``, position, anchor: every closed syncmer of the bytes in column ``data``.

    ``data`` has the zero bytes in front, or starts at byte ``shift`` of such data.
    ``position`` is that of the anchor's last byte in the text, ``anchor`` its hash.
    Data without an anchor has one row without them.
    """
    at = C(shift) if shift else F.lit(0)
    last = F.octet_length(data) - K
    rows = texts.select(*keys, data, at.cast("int").alias("_g"), last.cast("int").alias("_last"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.greatest(C("_last"), F.lit(0)), F.lit(STRIDE))).alias("_o"))
    n = STRIDE + INNER - 1
    rows = rows.select("*", *[F.xxhash64(F.substring(data, C("_o") + (j + 1), S)).alias(f"_h{j}") for j in range(n)])
    # the least of INNER neighbours, by doubling; one step a projection keeps the generated methods small
    of, span = "_h", 1
    while span < INNER:
        n -= span
        rows = rows.select(*keys, data, "_g", "_last", "_o", *[f"_h{j}" for j in range(STRIDE + INNER - 1)], *[F.least(f"{of}{j}", f"{of}{j + span}").alias(f"_m{span}_{j}") for j in range(n)])
        of, span = f"_m{span}_", 2 * span
    edge = [(C(f"{of}{j}") == C(f"_h{j}")) | (C(f"{of}{j}") == C(f"_h{j + INNER - 1}")) for j in range(STRIDE)]
    rows = rows.select(*keys, data, "_g", "_last", "_o", F.posexplode(F.array(*edge)).alias("_j", "_edge"))
    place = C("_o") + C("_j")
    there = (C("_edge") | (C("_g") + place < K - S)) & (place <= C("_last"))
    rows = rows.filter(there | (place == 0))
    return rows.select(*keys, F.when(there, C("_g") + place).alias("position"), F.when(there, F.xxhash64(F.substring(data, place + 1, K))).alias("anchor"))


def _cells(listed: Column, of: str) -> Column:
    """(anchor, position) of each filled cell, in the order of cells.

    A cell's number packs 32 bits of the hash above the position.
    """
    there = F.filter(listed, lambda x: x[of].isNotNull())
    return F.transform(there, lambda x: F.struct((F.shiftright(x[of], 31) * CELLS + x["cell"]).alias("anchor"), x[of].bitwiseAND(2**31 - 1).alias("position")))


def fingerprint_text(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda x: F.lpad(F.lower(F.hex(x["anchor"])), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of cells, of those filled on either side, that hold the same anchor."""
    same = F.size(F.array_intersect(a["anchor"], b["anchor"]))
    number = lambda x: F.transform(x["anchor"], lambda t: F.pmod(t, F.lit(CELLS)))
    filled = F.size(F.array_union(number(a), number(b)))
    return F.coalesce(F.try_divide(same, filled), F.lit(1.0))


def steps(a: Column, b: Column) -> Column:
    """Distances in bytes between the places of equal anchors, in order."""
    there = F.map_from_arrays(b["anchor"], b["position"])
    both = F.filter(a, lambda x: F.array_contains(b["anchor"], x["anchor"]))
    return F.array_sort(F.transform(both, lambda x: F.element_at(there, x["anchor"]) - x["position"]))


def edited(n: Column, text: Column, following: Column) -> tuple[Column, Column]:
    """What stays of ``text`` when its last quarter goes, and what comes in its place."""
    cut = F.floor(n / 4).cast("int")
    return F.substring(text, 1, (n - cut).cast("int")), F.substring(following, 1, cut)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, likeness to
    the edited text and to the next document, and by how much equal anchors moved."""
    rows = in_order(docs)
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("next_text", F.coalesce("next_text", F.lit("")))
    kept, tail = edited(C("n_chars"), C("text"), C("next_text"))
    rows = rows.select("range", "place", "edge", "doc_id", "n_chars", "text", kept.alias("_kept"), tail.alias("_tail"))
    start = F.concat(F.lit(PAD), C("_kept").cast("binary"))
    rows = rows.select(
        "range", "place", "edge", "doc_id", "n_chars",
        F.unhex(F.sha2(F.concat("_kept", "_tail").cast("binary"), 256)).alias("sha"),
        F.octet_length("_kept").cast("int").alias("stays"),
        F.concat(F.lit(PAD), C("text").cast("binary")).alias("_own"),
        F.concat(F.substring(start, F.octet_length("_kept") + 1, K - 1), C("_tail").cast("binary")).alias("_seam"),
    )
    # the seam has what is left before the first new byte, so its anchors are those that the edited text has more
    forms = F.array(F.struct(C("_own").alias("data"), F.lit(0).alias("from"), F.lit(True).alias("own")), F.struct(C("_seam").alias("data"), C("stays").alias("from"), F.lit(False).alias("own")))
    keys = ["range", "place", "edge", "doc_id", "n_chars", "sha"]
    rows = rows.select(*keys, "stays", F.explode(forms).alias("_f")).select(*keys, "stays", "_f.own", "_f.data", "_f.from")
    found = anchors(rows, [*keys, "stays", "own"], "data", "from")
    value = F.shiftleft(F.shiftrightunsigned("anchor", 32), 31) + C("position")
    found = found.select(*keys, "own", (C("position") < C("stays")).alias("_stays"), C("anchor").bitwiseAND(CELLS - 1).alias("cell"), value.alias("_v"))
    least = found.groupBy(*keys, "cell").agg(F.min(F.when(C("own"), C("_v"))).alias("own"), F.min(F.when(~C("own") | C("_stays"), C("_v"))).alias("edited"))
    listed = least.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(C("cell").isNotNull(), F.struct("cell", "own", "edited")))).alias("_l"))
    both = listed.select(*keys, _cells(C("_l"), "own").alias("_own"), _cells(C("_l"), "edited").alias("_edited"))
    both = both.withColumn("_next", F.lead("_own").over(Window.partitionBy("range").orderBy("place"))).filter(~C("edge"))
    both = both.withColumn("_steps", steps(C("_own"), C("_next")))
    return both.select(
        "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"),
        fingerprint_text(C("_own")).alias("fingerprint"), fingerprint_text(C("_edited")).alias("edited_fingerprint"),
        likeness(C("_own"), C("_edited")).alias("near_edited"), likeness(C("_own"), C("_next")).alias("near_next"),
        F.get("_steps", F.floor(F.size("_steps") / 2).cast("int")).alias("moved_next"),
    )
