"""Line dedup: globally repeated chunks of lines removed; DataFrame functions only.

line_dedup() cuts content-defined chunks at one line in `divisor`. passage_dedup(), which operator 6's query and the pipeline use, takes every line
for a boundary and lets chunks share it, as a passage of three lines seldom holds a whole chunk of the first kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import cut, dealt_join, fresh, hot_keys


def chunk_lines(text: Column, divisor: int = 4) -> Column:
    """The text's chunks in order; joined by line ends they are the text again.

    A line's hash is 32 bits of its MD5. The hash rolls over two lines: a chunk ends after a line if the sum of its hash and
    the line's before it (0 before the first) is a multiple of `divisor`, whatever stands elsewhere in the text. The
    lines are marked and joined once, then cut at the empty lines between marks, so the work grows with the text's length.
    """
    lines = F.split(text, "\n", -1)
    hashes = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long"))
    rolled = F.zip_with(hashes, F.concat(F.array(F.lit(0).cast("long")), hashes), lambda own, before: own + before)
    marked = F.zip_with(lines, rolled, lambda x, r: F.concat(F.lit("x"), x, F.when(r % divisor == 0, F.lit("\n\n")).otherwise(F.lit("\n"))))
    whole = F.rtrim(F.array_join(marked, ""), F.lit("\n"))  # what has no line beyond the last is null, which the join leaves out
    return F.transform(F.split(whole, "\n\n", -1), lambda c: F.regexp_replace(c, "(^|\n)x", "$1"))


def repeated_chunks(docs: DataFrame, divisor: int = 4, broadcast_rows: int = 500_000) -> DataFrame:
    """(doc_id, th, removed): places of a document's chunks that stand, byte for byte, somewhere before.

    docs: doc_id, th (the text's hash), text. Chunks of one line stay. Which chunks repeat is found from hashes alone,
    summed up before the shuffle; then the repeated ones' bytes are compared with those of the first by (doc_id, place).
    """
    chunks = docs.where("text is not null").select("doc_id", "th", F.posexplode(chunk_lines(F.col("text"), divisor)).alias("place", "chunk"))
    chunks = chunks.where(F.col("chunk").contains("\n")).withColumns({"h": F.xxhash64("chunk"), "at": F.struct("doc_id", "place", "th")})
    first = chunks.groupBy("h").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n")).where("first != last").select("h", "first", "n")
    first = cut(first, "first")
    hot, firsts = hot_keys(first, "h"), first.drop("n")
    # a row has some 60 bytes; beyond the bound both sides are shuffled, with the places of frequent chunks dealt over tasks
    small = first.count() <= broadcast_rows
    shared = chunks.join(F.broadcast(firsts), "h") if small else dealt_join(chunks, firsts, "h", hot, ["doc_id", "place"])
    shared = cut(shared, "shared")
    heads = shared.where("at = first").select("h", F.col("chunk").alias("bytes")).distinct()
    again = dealt_join(shared.where("at != first"), heads, "h", hot, ["doc_id", "place"]).where("chunk = bytes")
    return again.groupBy("doc_id", "th").agg(F.collect_set("place").alias("removed"))


def check_count_col(docs: DataFrame, count_col: str | None) -> None:
    if count_col and count_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"{count_col!r} is a column of the documents already")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = 4, count_col: str | None = None) -> DataFrame:
    """docs with the same columns; from the texts, chunks of several lines that stand somewhere before are removed.

    "Before" is by id, then by place; the first stays. Rows of equal id and text are one document: all lose the same, so
    the first occurrence stays in each. A null text stays null; a text of which all is removed is empty; an empty text
    or one line stays as it is. Rows without an id come first. count_col names a column for the number of chunks removed.
    """
    check_count_col(docs, count_col)
    of_id, of_text, removed, chunks = fresh(docs.columns, "gone_id", "gone_th", "gone", "chunks")
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    gone = repeated_chunks(keyed, divisor).withColumnsRenamed({"doc_id": of_id, "th": of_text, "removed": removed})
    joined = docs.join(gone, docs[id_col].eqNullSafe(gone[of_id]) & (F.xxhash64(docs[text_col]) == gone[of_text]), "left")
    split = joined.withColumn(chunks, F.when(F.col(removed).isNotNull(), chunk_lines(F.col(text_col), divisor)))
    kept = F.array_except(F.sequence(F.lit(0), F.size(chunks) - 1), removed)
    text = F.array_join(F.transform(kept, lambda k: F.get(F.col(chunks), k)), "\n")
    out = [F.when(F.col(removed).isNull(), F.col(c)).otherwise(text).alias(c) if c == text_col else F.col(c) for c in docs.columns]
    if count_col:
        out.append(F.coalesce(F.size(removed), F.lit(0)).cast("long").alias(count_col))
    return split.select(*out)


def line_pairs(text: Column) -> Column:
    """(place, to, chunk): each line with more than blanks and the next such line, by their numbers; what is between is blank."""
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    full = F.filter(lines, lambda s: s["x"].rlike(r"\S"))
    pairs = F.zip_with(full, F.slice(full, 2, F.greatest(F.size(full), F.lit(1))), lambda a, b: F.struct(a["i"].alias("place"), b["i"].alias("to"), F.concat(a["x"], F.lit("\n"), b["x"]).alias("chunk")))
    return F.filter(pairs, lambda s: s["to"].isNotNull())


def repeated_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id, th, removed): from and to lines of a document's pairs of lines that stand, byte for byte, somewhere before.

    docs: doc_id, th (the text's hash), text. Which pairs repeat is found from hashes and places alone; then the repeated ones' bytes are cut from
    their documents again, and compared with those of the first by (doc_id, place).
    """
    own = docs.where("text is not null")
    pairs = own.select("doc_id", "th", F.explode(line_pairs(F.col("text"))).alias("p")).select("doc_id", "th", "p.place", "p.to", F.xxhash64("p.chunk").alias("h"))
    at = F.struct("doc_id", "place", "th")
    first = pairs.groupBy("h").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).where("first != last").select("h", "first", "n")
    first = cut(first, "first_pairs")
    hot = hot_keys(first, "h")
    shared = dealt_join(pairs, first.drop("n"), "h", hot, ["doc_id", "place"]).select("doc_id", "th", F.struct("place", "to", "h", (at == F.col("first")).alias("head")).alias("w"))
    wanted = cut(shared.groupBy(F.col("doc_id").alias("in_id"), F.col("th").alias("in_th")).agg(F.collect_set("w").alias("wanted")), "wanted_pairs")  # at most a document's lines
    lines = own.join(wanted, own["doc_id"].eqNullSafe(wanted["in_id"]) & (own["th"] == wanted["in_th"])).select("doc_id", "th", "wanted", F.split("text", "\n", -1).alias("lines"))
    cells = F.transform("wanted", lambda w: F.struct(w["place"].alias("place"), w["to"].alias("to"), w["h"].alias("h"), w["head"].alias("head"), F.concat(F.get("lines", w["place"]), F.lit("\n"), F.get("lines", w["to"])).alias("chunk")))
    said = lines.select("doc_id", "th", F.explode(cells).alias("c")).select("doc_id", "th", "c.*")
    heads = said.where("head").select("h", F.col("chunk").alias("bytes")).distinct()
    again = dealt_join(said.where("not head").drop("head"), heads, "h", hot, ["doc_id", "place"]).where("chunk = bytes")
    return again.groupBy("doc_id", "th").agg(F.collect_set(F.struct("place", "to")).alias("removed"))


def chunk_numbers(text: Column, removed: Column, divisor: int) -> Column:
    """The numbers of the lines that stand in the chunks at the places removed."""
    of_line = F.flatten(F.transform(chunk_lines(text, divisor), lambda c, i: F.transform(F.split(c, "\n", -1), lambda x: F.array_contains(removed, i))))
    return F.filter(F.transform(of_line, lambda gone, n: F.when(gone, n)), lambda n: n.isNotNull())


def passage_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None, divisor: int | None = None) -> DataFrame:
    """docs with the same columns; from the texts, every run of two lines or more that stands somewhere before is removed.

    A line goes if it and the next or last line with more than blanks stand so somewhere before (by id, then by place),
    with the blank lines between; so no repeated passage of two such lines or more stays, whatever stands around it, and
    all that line_dedup() removes in such lines goes. Single lines stay, as do nulls, rows of equal id and text, and the
    order of rows as there. count_col names a column for the number of lines removed. With a divisor the content-defined chunks
    that line_dedup() removes go as well, both told from the whole texts: the pairs are then the exact check after the chunks.
    """
    check_count_col(docs, count_col)
    of_id, of_text, removed, lines, numbers, in_id, in_text, chunked = fresh(docs.columns, "gone_id", "gone_th", "gone", "lines", "out", "chunk_id", "chunk_th", "chunked")
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    gone = repeated_pairs(keyed).withColumnsRenamed({"doc_id": of_id, "th": of_text, "removed": removed})
    joined = docs.join(gone, docs[id_col].eqNullSafe(gone[of_id]) & (F.xxhash64(docs[text_col]) == gone[of_text]), "left")
    out_of, any_gone = F.array_distinct(F.flatten(F.transform(removed, lambda s: F.sequence(s["place"], s["to"])))), F.col(removed).isNotNull()
    if divisor:
        by_chunk = repeated_chunks(keyed, divisor).withColumnsRenamed({"doc_id": in_id, "th": in_text, "removed": chunked})
        joined = joined.join(by_chunk, docs[id_col].eqNullSafe(by_chunk[in_id]) & (F.xxhash64(docs[text_col]) == by_chunk[in_text]), "left")
        of_chunks = F.when(F.col(chunked).isNotNull(), chunk_numbers(F.col(text_col), F.col(chunked), divisor))
        none = F.array().cast("array<int>")
        any_gone = any_gone | F.col(chunked).isNotNull()
        out_of = F.when(any_gone, F.array_union(F.coalesce(out_of, none), F.coalesce(of_chunks, none)))
    split = joined.withColumns({lines: F.when(any_gone, F.split(F.col(text_col), "\n", -1)), numbers: out_of})
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), numbers)
    text = F.array_join(F.transform(kept, lambda k: F.get(F.col(lines), k)), "\n")
    out = [F.when(F.col(lines).isNull(), F.col(c)).otherwise(text).alias(c) if c == text_col else F.col(c) for c in docs.columns]
    if count_col:
        out.append(F.coalesce(F.size(numbers), F.lit(0)).cast("long").alias(count_col))
    return split.select(*out)
