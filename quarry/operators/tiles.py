"""Degrees and triangles of graphs given by groups, whose members are all joined: a dense graph as tiles of bits, no edge is a row."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.staging import ship, staged

if TYPE_CHECKING:
    import pyarrow as pa

#: Nodes of a block (a tile has a bit for each two nodes of two blocks), least blocks, rows of a tile that are stored together.
SIDE, BLOCKS, STRIP = 10_000, 4, 512
#: Members that are cut into pieces together, pairs that are set at once, and pairs from which a group is set by itself.
MEMBERS, PAIRS, LARGE = 1 << 17, 1 << 21, 1 << 12

_PIECE, _STRIP = "tile long, data binary", "x int, y int, at int, dense boolean, data binary"


def _cut(group: np.ndarray, code: np.ndarray, t: int, side: int) -> Iterator[tuple[int, bytes]]:
    """Pieces of tiles from the members of whole groups: which members of each two blocks are in the same group."""
    order = np.lexsort((code, group))
    group, code = group[order], code[order]
    new = np.r_[True, (group[1:] != group[:-1]) | (code[1:] != code[:-1])]
    group, code = group[new], code[new]
    _, inverse, size = np.unique(group, return_inverse=True, return_counts=True)
    code = code[size[inverse] > 1]
    inverse = np.unique(inverse[size[inverse] > 1], return_inverse=True)[1].astype(np.uint32)
    block, place = code // side, (code % side).astype(np.uint16)
    parts = [(inverse[block == b], place[block == b]) for b in range(t)]
    for x in range(t):
        for y in range(x, t):
            (gx, px), (gy, py) = parts[x], parts[y]
            inx, iny = np.isin(gx, gy), np.isin(gy, gx)
            if inx.any():
                arrays = gx[inx], gy[iny], px[inx], py[iny]
                yield x * t + y, b"".join([np.array([inx.sum(), iny.sum()], np.uint32).tobytes(), *(a.tobytes() for a in arrays)])


def _pieces(batches: Iterator[pa.RecordBatch], t: int, side: int) -> Iterator[pa.RecordBatch]:
    import pyarrow as pa

    def made(g, c):
        rows = list(_cut(g, c, t, side))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["tile", "data"])

    group, code, held, least = [], [], 0, MEMBERS
    for b in batches:
        group.append(b.column(0).to_numpy(zero_copy_only=False)), code.append(b.column(1).to_numpy(zero_copy_only=False))
        held += b.num_rows
        if held < least:
            continue
        g, c = np.concatenate(group), np.concatenate(code)
        last = int(np.searchsorted(g, g[-1]))  # the last group may go on
        if last:
            yield made(g[:last], c[:last])
        rest = np.unique(c[last:])
        group, code, held = [np.full(len(rest), g[-1])], [rest], len(rest)
        least = held + MEMBERS
    if held:
        yield made(np.concatenate(group), np.concatenate(code))


def _set(tile: np.ndarray, data: bytes) -> None:
    """Sets the pairs of a piece in a tile."""
    n, m = (int(x) for x in np.frombuffer(data, np.uint32, 2))
    gx, gy = np.frombuffer(data, np.uint32, n, 8), np.frombuffer(data, np.uint32, m, 8 + 4 * n)
    px, py = np.frombuffer(data, np.uint16, n, 8 + 4 * (n + m)), np.frombuffer(data, np.uint16, m, 8 + 4 * (n + m) + 2 * n)
    groups, fx, nx = np.unique(gx, return_index=True, return_counts=True)
    _, fy, ny = np.unique(gy, return_index=True, return_counts=True)
    large = nx * ny >= LARGE
    for i, k, j, m in zip(fx[large], nx[large], fy[large], ny[large], strict=True):
        tile[np.ix_(px[i : i + k], py[j : j + m])] = True
    rest = np.isin(gx, groups[~large])
    gx, px, n = gx[rest], px[rest], int(rest.sum())
    first = np.searchsorted(gy, gx)
    many = np.searchsorted(gy, gx, "right") - first
    for at in np.split(np.arange(n), np.flatnonzero(np.diff(np.cumsum(many) // PAIRS)) + 1):
        k = many[at]
        col = np.repeat(first[at] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        tile[np.repeat(px[at], k), py[col]] = True


def _strips(batches: Iterator[pa.RecordBatch], t: int, side: int) -> Iterator[pa.RecordBatch]:
    """Tiles from their pieces, which come tile by tile: strips of bits, or of cells where these are shorter."""
    import pyarrow as pa

    schema = pa.schema([("x", pa.int32()), ("y", pa.int32()), ("at", pa.int32()), ("dense", pa.bool_()), ("data", pa.binary())])
    now, tile = None, np.zeros((side, side), bool)

    def done():
        x, y = divmod(now, t)
        if x == y:
            np.fill_diagonal(tile, False)
        for at in range(0, side, STRIP):
            s = tile[at : at + STRIP]
            n = np.count_nonzero(s)
            dense = 4 * n >= s.size // 8
            if n:
                data = np.packbits(s, axis=1, bitorder="little") if dense else np.flatnonzero(s).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((x, y, at, dense, data.tobytes()), schema, strict=True)], schema=schema)
        tile[:] = False

    for b in batches:
        for i in range(b.num_rows):
            k = b.column(0)[i].as_py()
            if now is not None and k != now:
                yield from done()
            now = k
            _set(tile, b.column(1)[i].as_buffer())
    if now is not None:
        yield from done()


def _bits(strips: pd.DataFrame, x: int, y: int, side: int) -> np.ndarray:
    """A tile as words of bits, a row for each node of x."""
    out = np.zeros((side, side // 64), np.uint64)
    for s in strips[(strips["x"] == x) & (strips["y"] == y)].itertuples():
        if s.dense:
            rows = np.frombuffer(s.data, np.uint64).reshape(-1, side // 64)
        else:
            cells = np.zeros((min(STRIP, side - s.at), side), bool)
            cells.ravel()[np.frombuffer(s.data, np.uint32)] = True
            rows = np.packbits(cells, axis=1, bitorder="little").view(np.uint64)
        out[s.at : s.at + len(rows)] = rows
    return out


def _turned(bits: np.ndarray) -> np.ndarray:
    out = np.zeros_like(bits)
    for at in range(0, len(bits), STRIP):
        rows = np.unpackbits(bits[at : at + STRIP].view(np.uint8), axis=1, bitorder="little")
        out.view(np.uint8)[:, at // 8 : (at + len(rows)) // 8] = np.packbits(rows.T, axis=1, bitorder="little")
    return out


_LOW, _ONES, _BYTE, _TOP = np.uint64(0x00FF00FF00FF00FF), np.uint64(0x0001000100010001), np.uint64(8), np.uint64(48)


def _met(edges: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums by row and by column of what rows of ``a`` and ``b`` have in common, over the edges between them."""
    side, words = edges.shape
    row, col = np.zeros(side, np.int64), np.zeros(side, np.int64)
    buffer, counts = np.empty((STRIP, words), np.uint64), np.empty((STRIP, words), np.uint8)
    for r in np.flatnonzero(edges.any(axis=1) & a.any(axis=1)):
        to = np.flatnonzero(np.unpackbits(edges[r].view(np.uint8), bitorder="little"))
        some = np.flatnonzero(a[r])
        for at in range(0, len(to), STRIP):
            part = to[at : at + STRIP]
            if 4 * len(some) < words:
                n = np.bitwise_count(b[np.ix_(part, some)] & a[r, some]).sum(axis=1, dtype=np.int64)
            else:
                both = np.take(b, part, axis=0, out=buffer[: len(part)], mode="clip")
                np.bitwise_and(both, a[r], out=both)
                eight = np.bitwise_count(both, out=counts[: len(part)]).view(np.uint64)
                # eight counts in a word, then four sums, then one
                four = ((eight & _LOW) + ((eight >> _BYTE) & _LOW)).sum(axis=1)
                n = ((four * _ONES) >> _TOP).astype(np.int64)
            row[r] += n.sum()
            col[part] += n
    return row, col


def _counted(key: tuple, strips: pd.DataFrame, side: int) -> pd.DataFrame:
    """code, degree, triangles of three blocks i <= j <= k: triangles with a node in each, and degrees where i is j."""
    i, j, k = (int(x) for x in key)
    ij = _bits(strips, i, j, side)
    ik = ij if j == k else _bits(strips, i, k, side)
    jk = ik if i == j else _bits(strips, j, k, side)
    degree, triangles = ({b: np.zeros(side, np.int64) for b in (i, j, k)} for _ in range(2))
    if i == j:
        degree[i] += np.bitwise_count(ik).sum(axis=1, dtype=np.int64)
        if j != k:
            degree[k] += np.bitwise_count(_turned(ik)).sum(axis=1, dtype=np.int64)
    if ij.any() and ik.any() and jk.any():
        row, col = _met(ij, ik, jk)
        # where j is k, each triangle is met by two edges of i's node; where i is j, a tile has an edge both ways
        triangles[i] += row // 2 if j == k else row
        if i != j:
            triangles[j] += col
        if j != k:
            col = _met(ik, ij, _turned(jk))[1]
            triangles[k] += col // 2 if i == j else col
    out = []
    for b in degree:
        at = np.flatnonzero((degree[b] > 0) | (triangles[b] > 0))
        out.append(pd.DataFrame({"code": b * side + at, "degree": degree[b][at], "triangles": triangles[b][at]}))
    return pd.concat(out)


def triangles_of_groups(members: DataFrame) -> DataFrame:
    """id, degree, triangles of the graph that joins each two ids with a group (a long) in common; ids without an edge are left out.

    Nodes are dealt to blocks, and each two blocks have a tile with a bit for each two nodes. Groups
    set bits, so a pair of many groups is kept once and is never a row. Each three blocks have a task
    that counts, for every edge, the bits that the rows of its ends have in common. A task holds a
    few tiles of bounded size, whatever the number of nodes, edges or groups; where the graph is
    thin, tiles are lists of cells.
    """
    ship(members.sparkSession)
    ids = staged(members.select("id").distinct(), "nodes")
    t = max(BLOCKS, -(-ids.count() // SIDE))
    block = F.pmod(F.xxhash64("id"), F.lit(t))
    codes = staged(ids.select("id", block.cast("int").alias("block")).withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy("id")) - 1), "codes")
    side = -(-((codes.agg(F.max("place")).first()[0] or 0) + 1) // 512) * 512
    codes = codes.select("id", (F.col("block") * side + F.col("place")).alias("code"))
    m = members.join(codes, "id").select("group", "code").repartition("group").sortWithinPartitions("group")
    pieces = m.mapInArrow(partial(_pieces, t=t, side=side), _PIECE)
    tiles = pieces.repartition(min(1000, 2 * t * (t + 1)), "tile").sortWithinPartitions("tile").mapInArrow(partial(_strips, t=t, side=side), _STRIP)
    tiles = staged(tiles, "tiles")
    each = tiles.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(t - 1)))).withColumn("three", F.array_sort(F.array("x", "y", "z")))
    each = each.select(*(F.col("three")[n].alias(c) for n, c in enumerate("ijk")), "x", "y", "at", "dense", "data")
    counted = each.groupBy("i", "j", "k").applyInPandas(lambda key, strips: _counted(key, strips, side), "code int, degree long, triangles long")
    return counted.groupBy("code").agg(F.sum("degree").alias("degree"), F.sum("triangles").alias("triangles")).join(codes, "code").select("id", "degree", "triangles")
