"""Many patterns in many texts as an equi-join on sampled grams; no limit on either side.

Each text gives, of every few neighbouring grams (runs of bytes), the one with the smallest hash. A text that holds a pattern holds all its neighbourhoods,
so all grams that the pattern gives; where the pattern must stand between word boundaries, its words serve instead. A pattern is looked up by the rarest of them; what meets is verified on the whole text, so the result is exact.
A few small patterns are broadcast instead, after a check of their number and size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import _cut

#: (least length of a pattern in bytes, length of its grams): a pattern takes the first it is long enough for; a neighbourhood has least - gram + 1 grams.
TIERS = ((24, 12), (8, 6), (3, 3), (1, 1))
#: Texts are read in pieces of this many bytes, which overlap by a neighbourhood.
PIECE = 1 << 17


def _sampler(tiers: list[tuple[int, int]], own_tier: bool, known=None) -> Callable:
    """Rows (key, gram) of batches (key, value): the grams of all tiers, or of a pattern's own one; with ``known`` (a broadcast, sorted) only those. A batch of rows is
    read as one run of bytes, piece by piece, so that the work doesn't grow with the number of its texts."""
    piece = PIECE

    def bytes_of(column) -> tuple:
        """The bytes of an Arrow column of strings, and where each row begins and ends in them, without a copy; null: no bytes."""
        import numpy as np
        import pyarrow as pa

        column = column.fill_null("") if column.null_count else column
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        return (np.frombuffer(data, np.uint8)[: at[-1]] if data is not None and data.size else np.empty(0, np.uint8)), at

    def neighbourhoods(data, least: int, size: int):
        """The smallest hash of each ``least`` bytes' grams."""
        import numpy as np

        n, room, width = len(data) - size + 1, least - size + 1, 1 << (min(size, 8).bit_length() - 1)
        # Two words of a power of two bytes cover a gram.
        word = lambda at: np.ndarray((n,), f"<u{width}", data, at, (1,)).astype(np.uint64)
        h = word(0) * np.uint64(0x9E3779B97F4A7C15)
        h += word(size - width) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(size)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        span = 1
        while span < room:
            step = min(span, room - span)
            h = np.minimum(h[:-step], h[step:])
            span += step
        return h

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        # Most hashes that aren't known are told by their last bits.
        mask = np.uint64((1 << max(16, (8 * len(known.value)).bit_length())) - 1 if known is not None else 0)
        likely = np.zeros(int(mask) + 1, bool)
        if known is not None:
            likely[known.value.view(np.uint64) & mask] = True

        def wanted(low, start: int, at, least: int, shorter: int | None):
            """(row, gram) of a piece's neighbourhoods, each once."""
            # Of equal neighbours in a text the first stands for all; neighbourhoods over a text's end are none, and nor are those behind them.
            head = np.ones(len(low), bool)
            np.not_equal(low[1:], low[:-1], out=head[1:])
            head[at[np.searchsorted(at, start) : np.searchsorted(at, start + len(low))] - start] = True
            if known is not None:
                head &= likely[(low & mask).view(np.int64)]
            place = np.flatnonzero(head)
            found = low[place].view(np.int64)
            if known is not None and len(known.value):
                which = np.minimum(np.searchsorted(known.value, found), len(known.value) - 1)
                there = known.value[which] == found
                place, found, which = place[there], found[there], which[there]
            row = np.searchsorted(at, place + start, side="right") - 1
            some = place + start + least <= at[row + 1]
            if shorter is not None:
                some &= at[row + 1] - at[row] < shorter
            if known is not None and some.any():
                pairs = np.unique(row[some] * len(known.value) + which[some])
                return pairs // len(known.value), known.value[pairs % len(known.value)]
            row, found = row[some], found[some]
            order = np.lexsort((found, row))
            row, found = row[order], found[order]
            once = np.ones(len(row), bool)
            once[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
            return row[once], found[once]

        for batch in batches:
            data, at = bytes_of(batch.column(1))
            for least, size in tiers if batch.num_rows else ():
                longer = min((t[0] for t in tiers if t[0] > least), default=None) if own_tier else None
                for start in range(int(at[0]), int(at[-1]) - least + 1, piece):
                    low = neighbourhoods(np.ascontiguousarray(data[start : start + piece + least - 1]), least, size)
                    row, found = wanted(low, start, at, least, longer)
                    if len(row):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(found)], names=["key", "gram"])

    return run


def _sampled(rows: DataFrame, key: Column, value: Column, *how) -> DataFrame:
    narrow = rows.select(key.alias("key"), value.alias("value"))
    return narrow.mapInArrow(_sampler(*how), f"key {narrow.schema['key'].dataType.simpleString()}, gram long")


def _words(value: Column) -> Column:
    """Hashes of the distinct words of a text, in the sense of the boundaries of :func:`_holds`."""
    return F.array_distinct(F.transform(F.regexp_extract_all(value, F.lit(r"(?U)\w+"), F.lit(0)), lambda w: F.xxhash64(w)))


def _holds(text: Column, pattern: Column, words: bool) -> Column:
    if not words:
        return F.contains(text, pattern)
    plain = F.regexp_replace(pattern, r"([^\p{L}\p{N}\s_])", r"\\$1")
    return F.contains(text, pattern) & F.rlike(text, F.concat(F.lit(r"(?U)(?<!\w)"), plain, F.lit(r"(?!\w)")))


def find_patterns(texts: DataFrame, patterns: DataFrame, key: str, text: str, pattern: str, words: bool = False, few: int = 16, few_bytes: int = 1 << 16, most_known: int = 1 << 20) -> DataFrame:
    """texts and patterns joined where the text holds the pattern; ``words``: with no word character on either side of it.

    ``key`` names texts; a key may be null or repeated (rows of a key meet more candidates then, and are verified each by itself). Null and empty patterns are in no text;
    repeated patterns give a row each. The two sides share no column name. Up to ``few`` patterns of ``few_bytes`` in all are broadcast; up to ``most_known`` grams of patterns are
    (8 bytes each), to drop other grams where they arise; beyond that a semi join does it."""
    both = set(map(str.lower, texts.columns)) & set(map(str.lower, patterns.columns))
    if both:
        raise ValueError(f"columns on both sides: {sorted(both)}")
    column = lambda name: F.col(f"`{name}`")
    patterns = patterns.where(F.char_length(column(pattern)) > 0)
    texts = texts.where(F.char_length(column(text)) > 0)
    size = patterns.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(column(pattern))), F.lit(0)).alias("bytes")).first()
    if size["n"] <= few and size["bytes"] <= few_bytes:
        return texts.join(F.broadcast(patterns), _holds(column(text), column(pattern), words))
    if not words:
        return _anchored(texts, patterns, key, text, pattern, False, most_known)
    # A pattern that is a word is one of the text's words, so nothing has to be verified and the text doesn't travel unless the caller wants it.
    single = F.rlike(column(pattern), F.lit(r"(?U)^\w+\z"))
    each = texts.withColumn("_mp word", F.explode(F.array_distinct(F.regexp_extract_all(column(text), F.lit(r"(?U)\w+"), F.lit(0)))))
    found, rest = each.join(patterns.where(single), F.col("`_mp word`") == column(pattern)).drop("_mp word"), patterns.where(~single)
    return found if rest.isEmpty() else found.unionByName(_anchored(texts, rest, key, text, pattern, True, most_known))


def _anchored(texts: DataFrame, patterns: DataFrame, key: str, text: str, pattern: str, words: bool, most_known: int) -> DataFrame:
    column = lambda name: F.col(f"`{name}`")
    distinct = patterns.select(column(pattern).alias("p")).distinct()
    # Between boundaries every word of the pattern is a whole word of the text; a pattern without words goes by grams.
    named = distinct.select("p", F.explode(_words(F.col("p"))).alias("gram")) if words else None
    rest = distinct.where(~F.rlike("p", F.lit(r"(?U)\w"))) if words else distinct
    wanted = _sampled(rest, F.col("p"), F.col("p"), list(TIERS), True).select(F.col("key").alias("p"), "gram")
    wanted = _cut(wanted if named is None else wanted.unionByName(named))
    lengths = rest.select(F.octet_length("p").alias("n")).select(F.coalesce(*[F.when(F.col("n") >= least, least) for least, _ in TIERS]).alias("least")).distinct()
    used = {r["least"] for r in lengths.collect()}  # at most one row a tier
    tiers = [t for t in TIERS if t[0] in used]
    grams, hits = wanted.select("gram").distinct(), []
    if tiers:
        known = None
        if grams.limit(most_known + 1).count() <= most_known:
            import numpy as np

            known = texts.sparkSession.sparkContext.broadcast(np.sort(np.array([r["gram"] for r in grams.collect()], np.int64)))
        hits.append(_sampled(texts, column(key), column(text), tiers, False, known).select("key", "gram"))
    if words:
        hits.append(texts.select(column(key).alias("key"), F.explode(_words(column(text))).alias("gram")))
    hits = _cut(reduce(DataFrame.unionByName, hits).join(grams, "gram", "left_semi").select("key", "gram"))
    often = hits.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # A pattern with a gram that no text has is in none.
    rarest = wanted.join(often, "gram", "left").groupBy("p").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0")
    meet = hits.join(rarest.select("p", F.col("r.gram").alias("gram")), "gram").select(F.col("key").alias("_mp key"), F.col("p").alias("_mp pattern")).distinct()
    held = texts.join(meet, column(key).eqNullSafe(F.col("`_mp key`"))).where(_holds(column(text), F.col("`_mp pattern`"), words)).drop("_mp key")
    return held.join(patterns, F.col("`_mp pattern`") == column(pattern)).drop("_mp pattern")


def symbol_dependencies(files: DataFrame, symbols: DataFrame, interfaces: DataFrame) -> DataFrame:
    """(sibling, local_symbol, remote_symbol), distinct: the symbols(path, symbol_name) of a file depend on a sibling's interfaces(sibling, symbol) if files(path, content, imports, exports)
    names it as a word, imports a path that holds it, or exports it. Files without symbols, or with a null path, give nothing."""
    wanted = interfaces.select("symbol").distinct()
    named = find_patterns(files.select("path", "content"), wanted, "path", "content", "symbol", words=True).select("path", "symbol")
    imported = find_patterns(files.select("path", F.explode("imports").alias("import")).distinct(), wanted, "path", "import", "symbol").select("path", "symbol")
    exported = files.select("path", F.explode("exports").alias("symbol")).join(wanted, "symbol", "left_semi").select("path", "symbol")
    uses = named.unionByName(imported).unionByName(exported)
    pairs = uses.join(symbols.select("path", F.col("symbol_name").alias("local_symbol")).distinct(), "path").select("local_symbol", "symbol").distinct()
    return pairs.join(interfaces.select("sibling", "symbol").distinct(), "symbol").select("sibling", "local_symbol", F.col("symbol").alias("remote_symbol"))
