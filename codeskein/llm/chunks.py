"""Cutting oversized texts at natural boundaries by pointer doubling.

A text's cut points are its line starts; inside lines longer than an eighth of the limit or than the overlap also the
ends of white space, and, where those are far apart, places every sixteenth of the limit or nearer, so that an overlap
never lacks a place to start. Every cut point is joined to its
farthest legal successor: the end of the longest piece that may start there, stepped back by the overlap. The
successor table is squared until it is idempotent, and the reach of the first cut point under its powers is the
whole greedy cutting; all texts of a batch are derived in the same array operations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of cut points, the best first.
BLOCK, LINE, SPACE, INNER = 0, 1, 2, 3
KIND_NAMES = ("block", "line", "space", "inner")

_LINE = re.compile(r"\r\n|\n|\r")
_SPACE = re.compile(r"[ \t\f\v]+")


def cut_points(text: str, limit: int, overlap: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all legal cuts, 0 and the end among them, and their kinds; ``overlap`` is a tenth of the limit if not given."""
    best: dict[int, int] = {0: BLOCK, len(text): BLOCK}
    start, indent_before, blank_before = 0, 0, True
    long_line, stride = max(1, limit // 8), max(1, limit // 16)
    if overlap := limit // 10 if overlap is None else overlap:
        long_line, stride = min(long_line, overlap), min(stride, max(1, overlap - 1))
    ends = [m.end() for m in _LINE.finditer(text)]
    if not ends or ends[-1] != len(text):
        ends.append(len(text))
    for end in ends:
        line = text[start:end]
        bare = line.lstrip(" \t")
        blank, indent = not bare.strip(), len(line) - len(bare)
        if start:
            best[start] = BLOCK if blank_before and not blank or not blank and indent < indent_before else LINE
        if len(line) > long_line:
            spots = [start + m.end() for m in _SPACE.finditer(line)]
            before = start
            for spot in [*spots, end]:
                for inner in range(before + stride, spot, stride):
                    if text[inner - 1 : inner + 1] != "\r\n":
                        best.setdefault(inner, INNER)
                if spot < end:
                    best.setdefault(spot, SPACE)
                before = spot
        if not blank:
            indent_before = indent
        blank_before = blank
        start = end
    at = np.fromiter(sorted(best), np.int64, len(best))
    return at, np.fromiter((best[x] for x in at.tolist()), np.int8, len(best))


def _last_up_to(places: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each pair the index of the last of ``places`` in (low, high], else -1; ``of`` maps to cut-point indexes."""
    k = np.searchsorted(places, high, "right") - 1
    ok = (k >= 0) & (places[np.maximum(k, 0)] > low) if len(places) else np.zeros(len(low), bool)
    return np.where(ok, of[np.maximum(k, 0)], -1) if len(places) else np.full(len(low), -1)


def _first_from(places: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each pair the index of the first of ``places`` in [low, high), else -1."""
    if not len(places):
        return np.full(len(low), -1)
    k = np.searchsorted(places, low, "left")
    ok = (k < len(places)) & (places[np.minimum(k, len(places) - 1)] < high)
    return np.where(ok, of[np.minimum(k, len(places) - 1)], -1)


def successor_tables(at: np.ndarray, kind: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Per cut point: the cut point that ends the piece starting there, and the one that starts the next piece.

    A piece ends at the farthest block start in the second half of what is allowed, else at the farthest line
    start, else white space, else any cut point. The next piece starts at the first line start, else white space,
    else cut point, not more than ``overlap`` before that end and after the piece's own start; the last piece's
    successor is the text's end.
    """
    n = len(at)
    every = np.arange(n)
    high = at + limit
    by = {k: every[kind <= k] for k in (BLOCK, LINE, SPACE, INNER)}
    end = np.full(n, -1)
    for k, least in ((BLOCK, limit // 2), (LINE, limit // 4), (SPACE, limit // 8), (INNER, 0)):
        found = _last_up_to(at[by[k]], by[k], at + max(least, overlap), high)  # beyond the overlap, so that every piece adds text
        end = np.where(end < 0, found, end)
    end = np.where(high >= at[-1], n - 1, end)
    end[-1] = n - 1
    stop = at[end]
    start = np.full(n, -1)
    for k in (LINE, SPACE, INNER):
        start = np.where(start < 0, _first_from(at[by[k]], by[k], np.maximum(stop - overlap, at + 1), stop), start)
    start = np.where(start < 0, end, start)
    return end, np.where(end == n - 1, n - 1, start)


def reach(successor: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """All places on the paths from ``roots``: with every squaring of the table the known reach doubles."""
    marked = np.zeros(len(successor), bool)
    marked[roots] = True
    table = successor
    while True:
        before = marked.sum()
        marked[table[np.flatnonzero(marked)]] = True
        squared = table[table]
        if marked.sum() == before and np.array_equal(squared, table):
            return np.flatnonzero(marked)
        table = squared


def _pieces(pdf: pd.DataFrame) -> pd.DataFrame:
    ats, ends, nexts, owners, base, roots = [], [], [], [], 0, []
    for i, (text, limit, overlap) in enumerate(zip(pdf["text"], pdf["limit_chars"], pdf["overlap_chars"])):
        at, kind = cut_points(text, limit, overlap)
        end, following = successor_tables(at, kind, limit, overlap)
        ats.append(at)
        ends.append(end + base)
        nexts.append(following + base)
        owners.append(np.full(len(at), i))
        roots.append(base)
        base += len(at)
    at, end, owner = np.concatenate(ats), np.concatenate(ends), np.concatenate(owners)
    starts = reach(np.concatenate(nexts), np.array(roots))
    starts = starts[(at[end[starts]] > at[starts]) | (np.isin(starts, roots) & (end[starts] == starts))]
    texts, firsts = pdf["text"].tolist(), pdf["first_line"].tolist()
    rows, last_owner, last_end, piece, line, seen = [], -1, 0, 0, 0, 0
    for s in starts.tolist():
        o, a, b = int(owner[s]), int(at[s]), int(at[end[s]])
        text = texts[o]
        if o != last_owner:
            last_owner, last_end, piece, line, seen = o, a, 0, 0, 0
        line += len(_LINE.findall(text, seen, a))
        seen = a
        first = None if pd.isna(firsts[o]) else int(firsts[o]) + line
        rows.append((o, piece, a, b - a, last_end - a, first, text[a:b]))
        piece, last_end = piece + 1, b
    out = pd.DataFrame(rows, columns=["__o", "piece", "start", "n_chars", "overlap_before", "code_line", "code"])
    out.insert(0, "item_id", pdf["item_id"].to_numpy()[out.pop("__o").to_numpy(dtype=np.int64)])
    out["code_line"] = out["code_line"].astype("Int64")
    return out


#: Code points whose successor tables are held at a time; a longer text has them to itself.
TOGETHER = 4_000_000


def _bounded(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Runs of rows of at most TOGETHER code points together, or of one row."""
    begin, held = 0, 0
    for i, n in enumerate(pdf["text"].str.len()):
        if i > begin and held + n > TOGETHER:
            yield pdf.iloc[begin:i].reset_index(drop=True)
            begin, held = i, 0
        held += n
    if len(pdf) > begin:
        yield pdf.iloc[begin:].reset_index(drop=True)


_SCHEMA = "item_id long, piece int, start long, n_chars long, overlap_before long, code_line long, code string"


def split_oversized(items: DataFrame, overlap_share: float = 0.1, chars_per_token: int = 4, default_budget: int = 4000) -> DataFrame:
    """Pieces of every item whose ``code`` exceeds its budget: item_id, piece (from 0), start (code point offset),
    n_chars, overlap_before (code points shared with the piece before), code_line, code.

    The limit is ``chars_per_token`` times the budget (null: ``default_budget``; below 1 counts as 1 token). No
    piece exceeds it; pieces cover the text and lose nothing. Consecutive pieces share at most
    ``overlap_share`` of the limit, at least one code point wherever the limit leaves room. Items within the
    limit, null or empty code give no rows. Rows sent again under an ``item_id`` count once, the latest served
    of the oversized ones standing. Null ``code_line`` stays null; line ends are LF, CRLF or CR. Other columns
    are ignored.
    """
    if not 0 <= overlap_share < 0.5:
        raise ValueError("overlap_share must be in [0, 0.5)")
    limit: Column = F.greatest(F.lit(1), F.coalesce(F.col("token_budget"), F.lit(default_budget))).cast("long") * chars_per_token
    big = items.select("item_id", "code", "code_line", limit.alias("limit_chars"), "served_at").where(F.col("item_id").isNotNull() & (F.length("code") > F.col("limit_chars")))
    newest = F.max_by(F.struct("code", "code_line", "limit_chars"), F.struct("served_at", "code_line", "limit_chars", F.xxhash64("code")))
    big = big.groupBy("item_id").agg(newest.alias("x"))
    ready = big.select(
        "item_id",
        F.col("x.code").alias("text"),
        F.col("x.code_line").cast("long").alias("first_line"),
        F.col("x.limit_chars"),
        F.floor(F.col("x.limit_chars") * F.lit(overlap_share)).cast("long").alias("overlap_chars"),
    )

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in _bounded(pdf):
                yield _pieces(part)

    return ready.mapInPandas(split, _SCHEMA)
