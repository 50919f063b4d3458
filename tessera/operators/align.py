"""Global alignment at unit costs, with its path as a CIGAR string."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Half the bytes of rows that are held at a time.
HELD_CELLS = 8 << 20

#: Least half width of the band about the diagonal.
BAND = 256


def _block(query: bytes, masks: dict[int, int], low: int, high: int, first: int, past: int, plus: int, minus: int, held: list | None):
    """Rows first + 1..past over columns low + 1..high, a bit each, from the row first: where a column is one more, or one less, than the one before it.

    Held of each row: where a path across is none (the letters differ, and the cell is that before both), and where the
    cell is one more than that above. Left of the columns, rows grow by one.
    """
    columns = high - low
    full = (1 << columns) - 1
    own: dict[int, int] = {}
    for i in range(first, past):
        letter = query[i]
        equal = own.get(letter)
        if equal is None:
            equal = own[letter] = (masks.get(letter, 0) >> low) & full
        x = equal | minus
        level = ((((equal & plus) + plus) ^ plus) | x) & full
        up = minus | (full & ~(level | plus))
        down = plus & level
        if held is not None:
            held.append((level & ~equal, up))
        up_on = (up << 1 | 1) & full
        down_on = (down << 1) & full
        plus = down_on | (full & ~(level | up_on))
        minus = up_on & level
    return plus, minus


def align_with_cost(query: str, target: str) -> tuple[str, int]:
    """CIGAR of a least-cost alignment and the cost of that path; of equal ones the path that, from the end, prefers M, then I, then D.

    A row of the table is bits of whole numbers, its differences (Myers). Rows go in blocks, over the columns that a band
    about the diagonal reaches; a path no dearer than the band is wide lies within. Where the rows are more than can be
    held, only each block's first is, and the others are made again on the way back.
    """
    q, t = query.encode(), target.encode()
    n, m = len(q), len(t)
    codes = np.frombuffer(t, np.uint8)
    masks = {c: int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little") for c in set(t)}
    width = max(BAND, abs(n - m) + 8)
    while True:
        height = max(64, min(width, HELD_CELLS * 16 // (3 * width)))
        keep = n * (2 * width + height) // 4 <= HELD_CELLS * 2
        low, high = 0, min(m, height + width)
        plus, minus, score, blocks = (1 << high) - 1, 0, 0, []
        for first in range(0, n, height):
            past = min(n, first + height)
            low_on, high_on = min(m, max(0, first - width)), min(m, past + width)
            gone = (1 << (low_on - low)) - 1
            score += (plus & gone).bit_count() - (minus & gone).bit_count()  # the cell left of the columns
            plus, minus = plus >> (low_on - low), minus >> (low_on - low)
            if high_on > high:
                plus |= ((1 << (high_on - high)) - 1) << (high - low_on)
            low, high = low_on, max(high, high_on)
            rows = [] if keep else None
            blocks.append((first, past, low, high, plus, minus, rows))
            plus, minus = _block(q, masks, low, high, first, past, plus, minus, rows)
            score += past - first
        if score + plus.bit_count() - minus.bit_count() <= width or width >= max(n, m):
            break
        width *= 2
    out, cost, i, j, last, count = [], 0, n, m, "", 0
    for first, past, low, high, plus, minus, rows in reversed(blocks):
        if rows is None:
            rows = []
            _block(q, masks, low, high, first, past, plus, minus, rows)
        while i > first:
            barred, up = rows[i - 1 - first]
            at = j - 1 - low
            if j > low and not barred >> at & 1:
                op, step = "M", int(q[i - 1] != t[j - 1])
                i, j = i - 1, j - 1
            elif j == low or up >> at & 1:
                op, step = "I", 1
                i -= 1
            else:
                op, step = "D", 1
                j -= 1
            cost += step
            if op == last:
                count += 1
            else:
                if count:
                    out.append(f"{count}{last}")
                last, count = op, 1
    if j:
        cost += j
        if last == "D":
            count += j
        else:
            if count:
                out.append(f"{count}{last}")
            last, count = "D", j
    return (f"{count}{last}" if count else "") + "".join(reversed(out)), cost


def align(query: str, target: str) -> str:
    return align_with_cost(query, target)[0]


@F.pandas_udf(StructType([StructField("cigar", StringType()), StructField("cost", LongType())]))
def align_pair(query: pd.Series, target: pd.Series) -> pd.DataFrame:
    """The CIGAR and the cost of its path; null where a sequence is."""
    found = [(None, None) if q is None or t is None else align_with_cost(q, t) for q, t in zip(query, target)]
    return pd.DataFrame({"cigar": pd.Series([x for x, _ in found], dtype=object), "cost": pd.Series([x for _, x in found], dtype="Int64")})


@F.pandas_udf(StringType())
def align_cigar(query: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([None if q is None or t is None else align(q, t) for q, t in zip(query, target)], dtype=object)
