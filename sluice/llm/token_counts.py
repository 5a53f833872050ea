"""Token counts of a SentencePiece BPE model by rank-synchronous merging of ragged arrays.

A batch's distinct pre-tokens are held as one flat array of symbols with an array of the
sequence each belongs to. In each round every sequence merges its lowest-rank pair, all
sequences at once (``PieceModel.merge``); sequences without a pair left leave. What survives is
counted, byte pieces for characters without a piece included. Pre-tokens of any length go the
same way, long ones as overlapping windows that are put together at a token both hold, so a
round never holds more than a block of text. Counts of pre-tokens are kept for the next batches
in a bounded table.

Null and empty texts have no tokens. Whole texts are counted, however long; repeated rows alike.
An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm._shared import free_name, tune
from sluice.llm.piece_model import PieceModel, in_windows, load

#: Texts looked at together, and counts kept.
TEXTS, KEPT = 256, 500_000


def count_pretokens(words: list[str], model: PieceModel) -> np.ndarray:
    """The number of tokens of each pre-token."""
    of, token, _ = in_windows(words, model.merge)
    code = -1 - token  # of a character without a piece, which counts its UTF-8 bytes
    width = np.where(token >= 0, 1, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
    return np.bincount(of, width, len(words)).astype(np.int64)


def token_counts(docs: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """``docs`` without its text, with n_bytes and n_tokens; columns of those names are replaced."""
    tune(docs.sparkSession)
    with open(model_file, "rb") as f:
        content = f.read()  # half a megabyte, sent with the task: executors need no file
    held = [c for c in docs.columns if c != text and c.lower() not in ("n_bytes", "n_tokens")]
    body = free_name(docs, "body")
    rows = docs.select(*[F.col(f"`{c}`") for c in held], F.col(f"`{text}`").cast("string").alias(body))
    schema = rows.drop(body).withColumn("n_bytes", F.lit(0).cast("long")).withColumn("n_tokens", F.lit(0).cast("long")).schema

    def run(batches):
        model, known = load(content), {}
        for batch in batches:
            texts = [x or "" for x in batch.column(len(held)).to_pylist()]
            counts = []
            for k in range(0, len(texts), TEXTS):
                if len(known) > KEPT:
                    known.clear()
                split = [model.pretokens(x) for x in texts[k : k + TEXTS]]
                new = list(set().union(*split).difference(known))
                known.update(zip(new, count_pretokens(new, model).tolist()))
                counts += [sum(map(known.__getitem__, words)) for words in split]
            columns = [batch.column(i) for i in range(len(held))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(counts, pa.int64())], names=[*held, "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, schema)
