"""p10: texts over a size limit in pieces that end where the text itself breaks.

Positions are token positions of the whole text. A dynamic programme over all of them picks the ends that minimise the sum of cut penalties and of the squared deviation from even sizes, with every piece within the limit and
each piece beginning `overlap` tokens before the end of the one before it.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Penalties of a cut, by what the text has there (parameters of the programme, cheapest first).
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, CHARACTER = 0.0, 0.15, 0.3, 0.8, 1.5, 6.0
#: Cost of one piece, and weight of the squared relative deviation from an even size.
PIECE, BALANCE = 1.0, 2.0


#: Kinds of bytes beside a cut: other, line break, blank, end of a sentence, end of a clause, inside a character.
_KIND = bytes(1 if b in b"\n\r" else 2 if b in b" \t" else 3 if b in b".!?\"')" else 4 if b in b",;:-" else 5 if b & 0xC0 == 0x80 else 0 for b in range(256))


def _penalty(before: int, here: int) -> float:
    """Penalty of a cut between two kinds of bytes."""
    if here == 5:
        return float("inf")
    if before == 1 and here != 1:
        return LINE
    if before == 3 and here in (1, 2):
        return SENTENCE
    if before == 4 and here == 2:
        return CLAUSE
    return WORD if before == 2 or here in (1, 2) else CHARACTER


_PENALTY = [_penalty(before, here) for before in range(6) for here in range(6)]


def cut_penalties(raw: bytes, offsets):
    """Penalty of a cut at each byte offset; infinite inside a character."""
    import numpy as np

    padded = b"   " + raw + b"   "
    kind = np.frombuffer(padded.translate(_KIND), dtype=np.uint8)
    b = np.frombuffer(padded, dtype=np.uint8)
    cost = np.array(_PENALTY)[kind[offsets + 2] * np.uint8(6) + kind[offsets + 3]]
    i = np.flatnonzero(cost == LINE)
    p1, p2, p3 = (b[offsets[i] + k] for k in (2, 1, 0))
    cost[i[(p2 == 10) | (p2 == 13) & ((p1 == 13) | (p3 == 10))]] = PARAGRAPH
    if not raw.isascii():
        i = np.flatnonzero((kind[offsets + 2] == 5) & np.isfinite(cost))
        p1, p2, p3 = (b[offsets[i] + k] for k in (2, 1, 0))
        cjk, full = (p3 == 0xE3) & (p2 == 0x80), (p3 == 0xEF) & (p2 == 0xBC)
        cost[i[cjk & (p1 == 0x81) | full & (p1 == 0x8C)]] = CLAUSE
        cost[i[(cjk | full) & ((p1 == 0x82) | (p1 == 0x9F)) | full & (p1 == 0x81)]] = SENTENCE
    return cost


@lru_cache
def _widest(limit: int, overlap: int) -> int:
    """How far apart two ends at words may lie so that no best choice of ends has one amid a word between them; see `candidates`."""
    room = CHARACTER - 2 * WORD - PIECE - BALANCE * ((limit - overlap - 2) / limit) ** 2
    g = 0
    while BALANCE * (2 * (g + 1) / limit + ((g + 1) / limit) ** 2) < room and g + 1 + overlap <= limit:
        g += 1
    return g - 3


def candidates(cost, whole, limit: int, overlap: int):
    """The ends that can be in a best choice: whole characters beyond `overlap`, but for some amid words.

    An end amid a word is left out if ends at words lie close on both sides (`_widest`). In its place both of them, or
    one where the next end of the pieces isn't beyond the other, keep all pieces within the limit. They cost at most two
    word penalties and one more piece with the largest balance term there is, and the pieces beside change by a few tokens:
    all of it is less than the penalty that falls away. So no best choice of ends has such an end.
    """
    import numpy as np

    may = whole.copy()
    may[: overlap + 1] = False
    at_words = may & (cost < CHARACTER)
    at_words[-1] = True
    words = np.flatnonzero(at_words)
    near = np.flatnonzero(np.diff(words) <= _widest(limit, overlap))
    inside = np.zeros(len(may) + 1, dtype=np.int8)
    inside[words[near] + 1] += 1
    inside[words[near + 1]] -= 1
    return np.flatnonzero(may & (np.cumsum(inside[:-1], dtype=np.int8) == 0))


def split_points(raw: bytes, lengths, limit: int, overlap: int, block: int = 224):
    """`[(start, end), ...]` in tokens for a text of `sum(lengths)` bytes; `lengths` has the bytes of each token.

    One piece if it fits. Ends lie on whole characters, and every such position that can be in a best choice is a
    candidate (`candidates`). A start lies exactly
    `overlap` tokens before the last end, or up to three more where that would cut a character.

    Positions are worked out by blocks of `block` tokens against the earlier ends that may still begin a best piece. An
    earlier end is left out for good once a later one costs no more with the piece up to the current position: that piece
    can go on for longer, and the difference of the two squares only falls as the position moves on. Where the sums of a
    block say that an end within it could win, the block is halved. So the result is the minimum over all positions.
    """
    import numpy as np

    n = len(lengths)
    if n <= limit:
        return [(0, n)]
    offsets = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    cost = cut_penalties(raw, offsets)
    whole = np.isfinite(cost)
    whole[0] = whole[n] = True
    back = np.arange(n + 1)
    if not whole.all():
        back = np.maximum.accumulate(np.where(whole, back, 0))  # whole character at or before
    ends = candidates(cost, whole, limit, overlap)
    starts = back[ends - overlap]
    fee = cost[ends] + PIECE
    fee[-1] = PIECE
    count = max(1, -(-(n - overlap) // (limit - overlap)))
    even = overlap + (n - overlap) / count
    c = BALANCE / limit**2
    x = ends - even
    square = c * x * x
    terms, reach = np.column_stack((x, np.ones(len(x)))), ends - float(limit)
    # the ends that a piece may follow, as columns: the square (x - start)^2 is taken apart so that a block is one product.
    # Rows: where the piece begins, its factor of x, what is left of the sum without x, which end it is (-1: the beginning)
    columns = np.array((starts, -2 * c * starts, c * starts**2, np.arange(len(ends))))
    live = np.array([[0.0], [0.0], [0.0], [-1.0]])
    rows, at, space = np.arange(len(ends)), ends.tolist(), np.empty(0)
    a, span, came = 0, block, []
    while True:
        z = bisect_left(at, at[a] + span, a)
        used = live.shape[1]
        gone = int(live[0].searchsorted(at[z - 1] - limit)) if live[0, 0] < at[z - 1] - limit else 0
        if used - gone > 64:  # the best end to follow never moves back, so that of the last position bounds the others
            used = gone + int((live[1, gone:] * x[z - 1] + live[2, gone:]).argmin()) + 1
        size = (z - a) * used
        if size > len(space):
            space = np.empty(2 * size)
        sums = np.matmul(terms[a:z], live[1:3, :used], out=space[:size].reshape(z - a, used))
        if gone:
            np.putmask(sums, np.greater.outer(reach[a:z], live[0, :used]), np.inf)  # too long
        k = sums.argmin(axis=1)
        least = sums[rows[: z - a], k] + square[a:z]
        best = least + fee[a:z]
        # the ends within the block, with a piece that ends in it too: none of these is longer than up to the last end
        room = max(0.0, float(starts[a]) + even - at[z - 1])
        if z - a > 1 and np.minimum.reduce(best) + c * room * room < np.maximum.reduce(least):
            room = np.maximum(starts[a : z - 1] + (even - at[z - 1]), 0.0)
            if (np.minimum.accumulate(best[:-1] + c * room * room) < least[1:]).any():
                span = max(1, span // 2)
                continue
        came.append((a, live[3].take(k)))
        if z == len(at):
            break
        columns[2, a:z] += best
        live = np.concatenate((live, columns[:, a:z]), axis=1)
        if live[0, 0] < at[z] - limit:
            live = live[:, live[0].searchsorted(at[z] - limit) :]
        price = live[1] * x[z] + live[2]
        live = live.take(np.flatnonzero(price == np.minimum.accumulate(price[::-1])[::-1]), axis=1)
        a, span = z, min(block, 2 * span)
    if not np.isfinite(best[-1]):
        raise ValueError("no cut within the limit; limit and overlap are too close")
    out, j = [], len(ends) - 1
    while j >= 0:
        while came[-1][0] > j:
            came.pop()
        a, before = came[-1]
        i = int(before[j - a])
        out.append((int(starts[i]) if i >= 0 else 0, at[j]))
        j = i
    out.reverse()
    return out


def split_texts(df: DataFrame, key: str, text: str = "text", limit: int = 512, overlap: int = 32, path: str | None = None, with_text: bool = True, only_cut: bool = True) -> DataFrame:
    """`(key, piece_no, tok_start, tok_end, char_start, char_end[, text])`, pieces numbered from 0.

    Texts within the limit, empty and null ones have no row if `only_cut`, else one piece (empty texts: of size 0).
    Pieces without their overlap, put together, are the text. Repeated rows are cut again; columns besides `key` and
    `text` are not read. One pass without a shuffle.
    """
    from fleetweave.llm.automaton import shared_tables
    from fleetweave.llm.tokens import vocabulary

    if limit < overlap + 8:
        raise ValueError("limit must be at least 8 tokens over overlap")
    tables = shared_tables(df.sparkSession, path or vocabulary())
    names = [key, "piece_no", "tok_start", "tok_end", "char_start", "char_end"] + ["text"] * with_text

    def run(batches):
        import numpy as np
        import pyarrow as pa

        table = tables()
        labels = table.automaton.labels
        width = np.zeros(max(labels) + 1, dtype=np.int64)
        for i, t in labels.items():
            width[i] = len(t)
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.string()] * with_text
        for b in batches:
            rows, cols = [], [[] for _ in kinds]
            for r, t in enumerate(b.column(1).to_pylist()):
                t = t or ""
                raw = t.encode("utf-8", "surrogatepass")
                if only_cut and len(raw) <= limit:  # a token has at least one byte
                    continue
                ids = np.frombuffer(table.encode(t), dtype=np.int32)
                if only_cut and len(ids) <= limit:
                    continue
                lengths = width[ids]
                ascii_only = len(raw) == len(t)
                at = np.concatenate(([0], np.cumsum(lengths)))
                if not ascii_only:
                    lead = np.concatenate(([0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)))
                for no, (s, e) in enumerate(split_points(raw, lengths, limit, overlap)):
                    cs, ce = (at[s], at[e]) if ascii_only else (lead[at[s]], lead[at[e]])
                    rows.append(r)
                    for c, v in zip(cols, (no, s, e, int(cs), int(ce), t[cs:ce])):
                        c.append(v)
            keys = b.column(0).take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    kinds = [T.IntegerType(), *[T.LongType()] * 4] + [T.StringType()] * with_text
    schema = T.StructType([df.schema[key], *(T.StructField(c, k) for c, k in zip(names[1:], kinds))])
    return df.select(key, text).mapInArrow(run, schema)
