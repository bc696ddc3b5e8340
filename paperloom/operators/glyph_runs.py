"""Glyph rows to page text, in emission order.

The glyph table is the largest one, so its rows never cross the network one by
one. Each scan task packs the glyphs of a page that it meets into one compact
row (`_pack`), and only these packed rows, a few per page, are shuffled and
put together (`_assemble`). Both steps work on whole Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Separates glyph strings in a packed row; a glyph that holds it loses it.
UNIT = "\x1f"
GEOMETRY = np.dtype([("seq", "<i8"), ("along", "<f4"), ("across", "<f4"), ("height", "<f4"), ("width", "<f4")])

PACKED = "doc_id bigint, page_no bigint, geometry binary, glyphs string"
PAGES = "doc_id bigint, page_no bigint, text string"


def _floats(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.nan_to_num(pc.fill_null(batch.column(name), 0.0).to_numpy(zero_copy_only=False).astype("f4"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        doc = batch.column("doc_id").to_numpy(zero_copy_only=False)
        page = batch.column("page_no").to_numpy(zero_copy_only=False).astype("i8")
        rows = np.empty(len(doc), GEOMETRY)
        rows["seq"] = batch.column("seq").to_numpy(zero_copy_only=False)
        a, b, tx, ty = (_floats(batch, c) for c in ("a", "b", "tx", "ty"))
        upright = np.abs(a) >= np.abs(b)
        rows["along"] = np.where(upright, tx, ty)
        rows["across"] = np.where(upright, ty, tx)
        rows["height"], rows["width"] = _floats(batch, "height"), _floats(batch, "width")
        strings = pc.fill_null(batch.column("unicode"), "")
        if pc.any(pc.match_substring(strings, UNIT)).as_py():
            strings = pc.replace_substring(strings, UNIT, "")
        change = (doc[1:] != doc[:-1]) | (page[1:] != page[:-1])
        starts = np.concatenate(([0], np.flatnonzero(change) + 1))
        ends = np.append(starts[1:], len(doc))
        raw, unit = rows.tobytes(), GEOMETRY.itemsize
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(doc[starts], pa.int64()),
                pa.array(page[starts], pa.int64()),
                pa.array([raw[s * unit : e * unit] for s, e in zip(starts, ends)], pa.binary()),
                pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, len(doc)), pa.int32()), strings), UNIT),
            ],
            names=["doc_id", "page_no", "geometry", "glyphs"],
        )


def page_string(rows: np.ndarray, strings: list[str]) -> str:
    """Text of one page from its glyphs.

    Rows repeated exactly count once. A glyph that repeats the string of an
    earlier one less than a third of a character width away is an overprint and
    is dropped. A new line begins where the position across the writing
    direction moves by more than half a glyph height.
    """
    if (rows["seq"][1:] <= rows["seq"][:-1]).any():
        order = np.lexsort((rows["along"], rows["seq"]))
        rows = rows[order]
        strings = [strings[i] for i in order]
    names: dict[str, int] = {}
    code = np.fromiter((names.setdefault(s, len(names)) for s in strings), "i8", len(strings))
    reach = rows["width"] / 3.0
    keep = np.ones(len(rows), bool)
    along, across, seq = rows["along"].astype("f8"), rows["across"], rows["seq"]
    # one number to sort by: the string, the strip across, the place along the line in units that are far below a width
    place = np.clip(along * 64, -(1 << 25), (1 << 25) - 1).astype("i8") + (1 << 25)
    # strips twice as wide as anything reaches put near ones together; shifted by a half, also those on two sides of an edge
    wide = max(2.0 * float(reach.max(initial=0.0)), 0.02)
    for shift in (0.0, 0.5):
        strip = np.clip(np.floor(across / wide + shift), -(1 << 15), (1 << 15) - 1).astype("i8") + (1 << 15)
        cell = code << 16 | strip
        near = np.argsort(cell << 26 | place, kind="stable")
        for step in range(1, len(near)):
            first, second = near[:-step], near[step:]
            inside = np.flatnonzero((cell[first] == cell[second]) & (np.abs(along[second] - along[first]) <= np.maximum(reach[first], reach[second])))
            if not len(inside):
                break
            earlier, later = np.minimum(first[inside], second[inside]), np.maximum(first[inside], second[inside])
            apart = np.abs(along[earlier] - along[later])
            same = np.abs(across[earlier] - across[later]) <= np.maximum(reach[later], 0.01)
            same &= (apart < reach[later]) | ((seq[earlier] == seq[later]) & (apart == 0))
            keep[later[same]] = False
    rows, kept = rows[keep], np.flatnonzero(keep)
    if not len(rows):
        return ""
    turn = np.abs(np.diff(rows["across"])) > np.maximum(0.5 * np.maximum(rows["height"][1:], rows["height"][:-1]), 0.01)
    breaks = set((np.flatnonzero(turn) + 1).tolist())
    if not breaks:
        return "".join([strings[i] for i in kept])
    edges = [0, *sorted(breaks), len(kept)]
    return "\n".join("".join([strings[i] for i in kept[s:e]]).strip(" ") for s, e in zip(edges, edges[1:]))


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for parts in batch.column("parts").to_pylist():
            rows = np.concatenate([np.frombuffer(p["geometry"], GEOMETRY) for p in parts])
            strings = [s for p in parts for s in p["glyphs"].split(UNIT)]
            texts.append(page_string(rows, strings))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("page_no"), pa.array(texts, pa.string())], names=["doc_id", "page_no", "text"])


def page_texts(glyphs: DataFrame) -> DataFrame:
    """One row per page: ``doc_id, page_no, text``.

    Glyphs with a null ``unicode`` are unmapped codes and add no text; rows
    with a null ``doc_id``, ``page_no`` or ``seq`` belong to no place on a page
    and are left out. A page whose glyphs are all unmapped gives an empty text.
    Null coordinates count as 0. Extra columns are ignored; an empty table
    gives no rows. A page is one record of the result, so its glyphs meet in
    one task, like the characters of any other text value.
    """
    columns = ["doc_id", "page_no", "seq", "unicode", "a", "b", "tx", "ty", "height", "width"]
    rows = glyphs.select(*columns).where("doc_id is not null and page_no is not null and seq is not null").withColumns({"doc_id": F.col("doc_id").cast("bigint"), "seq": F.col("seq").cast("bigint")})
    packed = rows.mapInArrow(_pack, PACKED)
    return packed.groupBy("doc_id", "page_no").agg(F.collect_list(F.struct("geometry", "glyphs")).alias("parts")).mapInArrow(_assemble, PAGES)
