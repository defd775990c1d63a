"""Text expressions: product rendering, excerpts, tokens, window and separator chunking."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CHUNK_SIZE = 512
CHUNK_OVERLAP = 64
SEPARATORS = ("\n\n", "\n", " ")


def number_text(value: Column) -> Column:
    """A double the way a price list prints it: 45.0, 49.9, 12000000.0.

    The plain string cast switches to an exponent at ten million, so large
    values go through a decimal.
    """
    plain = value.cast("string")
    digits = F.regexp_replace(value.cast("decimal(38,10)").cast("string"), r"0+$", "")
    return F.when(F.abs(value) >= 1e7, F.regexp_replace(digits, r"\.$", ".0")).otherwise(plain)


def product_text() -> Column:
    """One line of eleven labelled parts; lists joined by commas, stock as ``size: qty``."""
    stock = F.transform(
        F.map_entries("stock"), lambda e: F.concat(e["key"], F.lit(": "), e["value"].cast("string"))
    )
    # fixed values: the labels and their order
    parts = [
        ("SKU", F.col("sku")),
        ("Name", F.col("name")),
        ("Category", F.col("category")),
        ("Fabric", F.col("fabric")),
        ("Colors", F.array_join("colors", ", ")),
        ("Sizes", F.array_join("sizes", ", ")),
        ("Price", F.concat(number_text(F.col("price_eur")), F.lit(" EUR"))),
        ("Description", F.col("short_description")),
        ("Occasion", F.array_join("occasion", ", ")),
        ("Care", F.col("care_instructions")),
        ("Stock", F.array_join(stock, ", ")),
    ]
    labelled = [F.concat(F.lit(f"{label}: "), F.coalesce(value, F.lit(""))) for label, value in parts]
    return F.concat_ws(". ", *labelled)


def excerpt(text: Column, length: int = 300) -> Column:
    """The first characters followed by three dots, which are always appended."""
    return F.concat(F.substring(text, 1, length), F.lit("..."))


def tokens(text: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda word: word != "")


def let(value: Column, body) -> Column:
    """``body`` applied to ``value``, which is evaluated once however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def term_counts(words: Column) -> Column:
    """``struct<terms, tfs>``: the distinct words in order and how often each occurs.

    Equal words are neighbours in the sorted list, so the counts are the
    distances between the places where a new word starts.  One pass within the
    row; neither an explode nor a shuffle.
    """

    def count(ordered: Column) -> Column:
        new = F.filter(
            F.sequence(F.lit(1), F.size(ordered)),
            lambda i: (i == 1) | (F.element_at(ordered, i) != F.element_at(ordered, i - 1)),
        )
        return let(F.when(F.size(ordered) > 0, new).otherwise(F.array().cast("array<int>")), between(ordered))

    def between(ordered: Column):
        def pair(starts: Column) -> Column:
            ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(F.size(ordered) + 1))
            tfs = F.when(F.size(starts) > 0, F.zip_with(ends, starts, lambda e, s: e - s))
            return F.struct(
                F.transform(starts, lambda i: F.element_at(ordered, i)).alias("terms"),
                F.coalesce(tfs, F.array().cast("array<int>")).alias("tfs"),
            )

        return pair

    return let(F.sort_array(words), count)


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


# a long text is cut into stretches of this many characters first
_STRETCH = 64 * (CHUNK_SIZE - CHUNK_OVERLAP)


def with_reader(text: Column, longest: int, body) -> Column:
    """``body(read)``, where ``read(start, n)`` is the substring at a 0-based start, ``n <= longest``.

    Finding a character means walking the text from its beginning, so reading
    every part of a text takes quadratic time.  The text is cut once into
    stretches that overlap by ``longest``, and each read walks one of them.
    """
    last = F.floor(F.length(text) / F.lit(_STRETCH)).cast("int")
    stretches = F.transform(
        F.sequence(F.lit(0), last), lambda j: F.substring(text, j * _STRETCH + 1, F.lit(_STRETCH + longest))
    )

    def reading(cut: Column) -> Column:
        def read(start: Column, n: Column) -> Column:
            stretch = F.element_at(cut, F.floor(start / F.lit(_STRETCH)).cast("int") + 1)
            return F.substring(stretch, start % _STRETCH + 1, n)

        return body(read)

    return let(stretches, reading)


def _cut(text: Column, spans: Column, longest: int) -> Column:
    """The stripped, non-empty substrings of ``text`` at ``array<struct<s,e>>`` spans."""

    def cut(read) -> Column:
        pieces = F.transform(spans, lambda p: stripped(read(p["s"], p["e"] - p["s"])))
        return F.filter(pieces, lambda piece: piece != "")

    return with_reader(text, longest, cut)


def window_spans(length: Column, base: Column, size: int, overlap: int) -> Column:
    """Spans of fixed windows over ``length`` characters that start at ``base``."""
    step = size - overlap

    def windows(v: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((v["n"] - size) / F.lit(step)).cast("int"))),
            lambda i: F.struct(
                (v["base"] + i * step).alias("s"),
                (v["base"] + F.least(i * step + size, v["n"])).alias("e"),
            ),
        )

    return let(F.struct(length.alias("n"), base.alias("base")), windows)


def fixed_chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Overlapping windows of at most ``size`` characters, kept as they are."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / F.lit(step)).cast("int"))
    starts = F.transform(F.sequence(F.lit(0), last), lambda i: i * step)
    windows = with_reader(text, size, lambda read: F.transform(starts, lambda at: read(at, F.lit(size))))
    return F.when(F.length(text) > 0, windows)


def _pieces(text: Column, separator: str) -> Column:
    """Split at the separator, which stays at the head of the piece after it."""
    parts = F.split(text, "\\Q" + separator + "\\E", -1)
    headed = F.transform(
        parts, lambda part, i: F.when(i == 0, part).otherwise(F.concat(F.lit(separator), part))
    )
    return F.filter(headed, lambda piece: piece != "")


_NO_SPANS = "array<struct<s:int,e:int>>"


def _fold_pieces(text: Column, base: Column, separators: tuple[str, ...], size: int, overlap: int) -> Column:
    """Pack the pieces of ``text`` one after the other.

    Chunks are runs of neighbouring pieces, so they are kept as offsets: the
    fold carries ``out`` (finished spans), ``starts`` (offsets of the pieces in
    the open run) and ``pos`` (end of the last piece).  When a piece does not
    fit, the run is closed and the longest tail that both stays within the
    overlap and leaves room for the piece opens the next run.  A piece of
    ``size`` or more closes the run and is divided at the next separator.
    """
    separator, finer = separators[0], separators[1:]

    def closed(acc: Column) -> Column:
        span = F.struct(F.element_at(acc["starts"], 1).alias("s"), acc["pos"].alias("e"))
        return F.when(F.size(acc["starts"]) > 0, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])

    def state(out: Column, starts: Column, pos: Column) -> Column:
        return F.struct(out.alias("out"), starts.alias("starts"), pos.alias("pos"))

    def step(acc: Column, piece: Column) -> Column:
        pos, starts = acc["pos"], acc["starts"]
        length = F.length(piece)
        too_long = state(
            F.concat(closed(acc), _split_spans(piece, pos, finer, size, overlap)),
            F.array().cast("array<int>"),
            pos + length,
        )
        tail = F.filter(starts, lambda s: pos - s <= F.least(F.lit(overlap), size - length))
        overflow = state(closed(acc), F.concat(tail, F.array(pos)), pos + length)
        fits = state(acc["out"], F.concat(starts, F.array(pos)), pos + length)
        open_run = F.coalesce(F.try_element_at(starts, F.lit(1)), pos)
        return (
            F.when(length >= size, too_long).when(pos + length - open_run > size, overflow).otherwise(fits)
        )

    start = state(F.array().cast(_NO_SPANS), F.array().cast("array<int>"), base.cast("int"))
    return F.aggregate(_pieces(text, separator), start, step, closed)


def _find(needle: str, text: Column, position: Column) -> Column:
    """1-based place of the needle at or after the position, 0 if there is none."""
    return F.call_function("locate", F.lit(needle), text, position)


def _fold_runs(text: Column, base: Column, separator: str, size: int, overlap: int) -> Column:
    """The same chunks for one-character separators and pieces all shorter than ``size``.

    Works a chunk at a time instead of a piece at a time: the end of a run is
    the last separator inside the next ``size + 1`` characters, and the start
    of the following run is the first separator of the admissible tail.  Two
    neighbouring runs and the piece between them exceed ``size``, so
    two steps advance by more than ``size - overlap`` characters; that bounds
    the number of steps.
    """
    steps = F.floor(F.length(text) * 2 / F.lit(size - overlap)).cast("int") + 2

    def step(read, acc: Column) -> Column:
        def advance(window: Column) -> Column:
            # window starts at the run and holds up to 2 * size characters
            head = F.substring(window, 1, size + 1)
            whole = F.length(head) <= size
            end = F.when(whole, F.length(head)).otherwise(
                F.length(head) - F.locate(separator, F.reverse(head))
            )

            def close(at: Column) -> Column:
                next_end = _find(separator, window, at + 2)
                piece = F.when(next_end > 0, next_end - 1).otherwise(F.length(window)) - at
                room = F.least(F.lit(overlap), size - piece)
                # the run and the piece exceed size, so the tail is shorter than the run
                tail = _find(separator, window, at - room + 1) - 1
                span = F.struct((base + acc["at"]).alias("s"), (base + acc["at"] + at).alias("e"))
                return F.struct(
                    F.concat(acc["out"], F.array(span)).alias("out"),
                    F.when(whole, F.lit(-1)).otherwise(acc["at"] + tail).alias("at"),
                )

            return let(end, close)

        going = let(read(acc["at"], F.lit(2 * size)), advance)
        return F.when(acc["at"] < 0, acc).otherwise(going)

    start = F.struct(F.array().cast(_NO_SPANS).alias("out"), F.lit(0).alias("at"))

    def fold(read) -> Column:
        every = F.sequence(F.lit(1), steps)
        return F.aggregate(every, start, lambda acc, _: step(read, acc), lambda acc: acc["out"])

    return with_reader(text, 2 * size, fold)


def _split_spans(text: Column, base: Column, separators: tuple[str, ...], size: int, overlap: int) -> Column:
    """Chunk spans of ``text``, whose first character is number ``base`` of the document."""
    if not separators:
        return window_spans(F.length(text), base, size, overlap)
    # a text without the separator is one piece, which goes on to the next one if it is too long
    folded = _fold_pieces(text, base, separators, size, overlap)
    if separators[0] != " ":
        return folded
    short = ~text.rlike("[^ ]{%d}" % (size - 1))
    return F.when(short, _fold_runs(text, base, " ", size, overlap)).otherwise(folded)


def recursive_chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Chunks that keep paragraph, then line, then word boundaries where they can."""
    spans = _split_spans(text, F.lit(0), SEPARATORS, size, overlap)
    return F.when(F.length(text) > 0, _cut(text, spans, size))
