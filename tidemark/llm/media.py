"""Media columns: texts stored as baseline JPEG, read back as DC-only thumbnails.

`store_texts` pads the UTF-8 bytes of a text with zero bytes to a positive multiple of 64 and stores
them as the luminance samples of one or more pictures, 64 blocks wide. `read_media` parses stored files
(these or any other baseline JPEG) and returns dimensions, the thumbnail's samples and a hash of the
thumbnail. Both are maps over rows: nothing is shuffled, and a batch is cut into pieces of about
256 kB so that memory does not grow with the input; one very long text is a piece of its own.

Edge cases: null and empty texts store 64 zero bytes. Equal texts give equal files. Repeated rows are
kept. A stored value that is null or no baseline JPEG is returned with null results. Columns other than the
named ones are not read, so clashing names do no harm. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import jpeg

PIECE = 1 << 18


def _pieces(values: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of values of about PIECE bytes each."""
    first = size = 0
    for i, x in enumerate(values):
        size += len(x)
        if size >= PIECE:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(values):
        yield first, len(values)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): the text's length in bytes and its file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for s, e in _pieces(texts):
                padded = [x + b"\0" * (-len(x) % jpeg.ROW or (0 if x else jpeg.ROW)) for x in texts[s:e]]
                sizes = pa.array([len(x) for x in texts[s:e]], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0)[s:e], sizes, pa.array(jpeg.encode(padded), pa.binary())], ["id", "n_bytes", "media"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).alias("id"), text.alias("text")).mapInArrow(
        run, f"id {docs.select(id_col).dtypes[0][1]}, n_bytes long, media binary"
    )


def thumbnail_hash(image: np.ndarray) -> str:
    """Average and difference hashes over 8 by 8 means of the thumbnail, as hex digits."""
    for axis in (0, 1):
        n = image.shape[axis]
        low = np.arange(8) * n // 8
        high = np.maximum(low + 1, np.arange(1, 9) * n // 8)
        sums = np.cumsum(image.astype(np.float64), axis=axis)
        sums = np.concatenate((np.zeros_like(sums.take([0], axis)), sums), axis)
        shape = (-1, 1) if axis == 0 else (1, -1)
        image = (sums.take(high, axis) - sums.take(low, axis)) / (high - low).reshape(shape)
    bits = np.concatenate(((image > image.mean()).ravel(), (image > np.roll(image, 1, axis=1)).ravel()))
    return np.packbits(bits).tobytes().hex()


def _read(files: list[bytes | None]) -> list[dict | None]:
    try:
        pictures = iter(jpeg.thumbnails([x for x in files if x]))
        found = [next(pictures) if x else None for x in files]
    except (ValueError, KeyError, IndexError, StopIteration):
        return [None] if len(files) == 1 else [y for x in files for y in _read([x])]
    out = []
    for own in found:
        if not own:
            out.append(None)
            continue
        out.append({
            "width": own[0][0], "height": sum(h for _, h, _ in own),
            "thumbnail": b"".join(x.tobytes() for _, _, x in own),
            "thumb_hash": thumbnail_hash(np.concatenate([x for _, _, x in own]) if len({x.shape[1] for _, _, x in own}) == 1 else own[0][2]),
        })
    return out


def read_media(stored: DataFrame, media_col: str = "media") -> DataFrame:
    """The rows of `stored` with width, height, thumbnail and thumb_hash; heights of pictures in a row are summed.

    Columns of `stored` with one of these names are replaced.
    """
    made = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("thumbnail", pa.binary()), ("thumb_hash", pa.string())])
    kept = [c for c in stored.columns if c not in made.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = b.column(kept.index(media_col)).to_pylist()
            for s, e in _pieces([x or b"" for x in files]):
                cols = pa.array(_read(files[s:e]), made)
                yield pa.RecordBatch.from_arrays([*(c[s:e] for c in b.columns), *cols.flatten()], [*kept, *made.names])

    rows = stored.select(*kept)
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{schema}, width int, height int, thumbnail binary, thumb_hash string")
