"""Problem 7: the whole corpus as token ids of a public tokenizer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lithoscope.llm.bpe import PrefixEncoder, read_ranks
from lithoscope.session import need

_ENCODERS: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    """One encoder for a Python worker and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PrefixEncoder(read_ranks(path))
    return _ENCODERS[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode_corpus(documents: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, `ids`: the token ids of each text, without special tokens.

    One narrow pass in Arrow batches, no shuffle. `vocabulary` is the path of the
    rank file, which every executor must be able to read. Defined results: a
    null, empty or absent text gives an empty list; repeated rows give repeated
    rows; a null id is kept; texts are encoded whole, whatever their length;
    strings that look like special tokens are ordinary text.
    """
    ids_type = documents.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoder(vocabulary)
        for b in batches:
            texts = b.column(1)
            for lo in range(0, len(b), 256):
                rows = [enc.encode(t) for t in texts.slice(lo, 256).to_pylist()]
                ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
                values = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 256), pa.ListArray.from_arrays(pa.array(ends), values)], names=[id_col, "ids"])

    return need(documents, id_col, text_col).mapInArrow(run, f"`{id_col}` {ids_type}, ids array<int>")
