"""Helpers of functions that run on Arrow batches of texts."""

from collections.abc import Iterable, Iterator

import pyarrow as pa


def in_pieces(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts have at most most_bytes, or are a single row."""
    for batch in batches:
        begin = size = 0
        for row, text in enumerate(batch.column(column)):
            length = text.as_buffer().size if text.is_valid else 0
            if size and size + length > most_bytes:
                yield batch.slice(begin, row - begin)
                begin, size = row, 0
            size += length
        if begin < batch.num_rows:
            yield batch.slice(begin)
