"""The functions Spark has no built-in for, on whole Arrow batches."""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@arrow_udf(StringType())
def nfc_arrow(text: pa.Array) -> pa.Array:
    """NFC form of each text."""
    # Arrow's own utf8_normalize gave decomposed text in the installed version
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in text.to_pylist()], pa.string())


@arrow_udf(ArrayType(LongType()))
def line_ends(text: pa.Array) -> pa.Array:
    """Byte offset after each line of each text; an unfinished last line counts."""
    text = pc.fill_null(text, "").cast(pa.large_string())
    n = len(text)
    if n == 0:
        return pa.array([], pa.list_(pa.int64()))
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + n + 1]
    data = text.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    body = raw[offsets[0]:offsets[-1]]
    newline_ends = np.flatnonzero(body == 10) + 1 + offsets[0]
    text_ends = offsets[1:][np.diff(offsets) > 0]
    ends = np.union1d(newline_ends, text_ends)
    stops = np.searchsorted(ends, offsets, side="right").astype(np.int32)
    relative = ends - np.repeat(offsets[:-1], np.diff(stops))
    return pa.ListArray.from_arrays(pa.array(stops), pa.array(relative, pa.int64()))


@arrow_udf(ArrayType(StructType([StructField("term", StringType()), StructField("positions", ArrayType(IntegerType()))])))
def term_places(tokens: pa.Array) -> pa.Array:
    """Each distinct token of each row with its positions in the row, in order."""
    n = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0), np.int64)
    coded = tokens.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    key = row * max(len(coded.dictionary), 1) + np.asarray(coded.indices, np.int64)
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    places = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(pos[order], pa.int32()))
    entries = pa.StructArray.from_arrays([coded.dictionary.take(coded.indices.take(pa.array(order[first]))).cast(pa.string()), places], ["term", "positions"])
    ends = np.cumsum(np.bincount(row[order[first]], minlength=len(n))) if len(n) else n
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), entries)
