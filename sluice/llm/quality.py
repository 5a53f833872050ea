"""Quality rules: word and line counts, and compression bands by zstandard.

The ratio of a text's bytes to their compressed size is high for repetitive text and near one
for text without structure. It is taken over the whole document and over fixed chunks, and
each is held against limits for its length, since short inputs compress less. A document is
rejected if its whole ratio lies outside its band, or if chunks outside theirs hold more than
``bad_share`` of its bytes.

Words are runs of anything but ASCII white space. Null and empty texts have no words and fail
the base rules. Very long texts are judged whole, all their chunks counted. A ratio of exactly a
limit is inside its band. Repeated rows are judged alike. An empty table gives an empty result.
Columns named like the new ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm._shared import free_name, tune, utf8

#: (bytes up to, least ratio, most ratio); lengths beyond the last row use it.
BANDS = ((128, 0.0, 2.5), (256, 0.0, 2.2), (512, 1.0, 2.2), (1024, 1.1, 2.3), (2048, 1.2, 2.4), (4096, 1.25, 2.5), (8192, 1.3, 2.7), (16384, 1.3, 2.9), (1 << 62, 1.3, 3.3))
CHUNK, LEVEL, BAD_SHARE = 4096, 3, 0.3
_SYMBOLS = "#*$%&|<>"
_NEW = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, bad_chunk_share double, base_failed boolean, kept boolean"


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """How many words lie in a window of ``window`` words (a power of two) that the text holds at least twice.

    Windows are told apart exactly: the classes of two neighbouring halves make the class of the whole.
    """
    if len(words) <= window:
        return 0
    known: dict[bytes, int] = {}
    of = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    width = 1
    while width < window:
        both = of[:-width] * (int(of.max()) + 1) + of[width:]
        of, width = np.unique(both, return_inverse=True)[1], width * 2
    again = np.bincount(of)[of] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[: len(again)] += again
    edge[window : window + len(again)] -= again
    return int((np.cumsum(edge)[:-1] > 0).sum())


def band(n: int, bands=BANDS) -> tuple[float, float]:
    """The least and the most ratio allowed for ``n`` bytes."""
    return next((low, high) for most, low, high in bands if n <= most)


def judge(data: bytes, compressor, bands=BANDS, chunk: int = CHUNK, bad_share: float = BAD_SHARE) -> tuple:
    """The columns named in the module's result for one text."""
    words = data.split()
    text = data.decode("utf-8", "replace")
    word_chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    lines = [x for x in data.split(b"\n") if x.strip()] if b"\n" in data else []
    repeats = repeated_words(words)
    failed = len(words) < 20 or 100 * repeats > 30 * len(words)

    def inside(part: bytes) -> bool:
        low, high = band(len(part), bands)
        return low <= len(part) / len(compressor.compress(part)) <= high

    ratio = len(data) / len(compressor.compress(data)) if data else 0.0
    bad = 0
    if len(data) > chunk:
        bad = sum(len(part) for k in range(0, len(data), chunk) if not inside(part := data[k : k + chunk]))
    low, high = band(len(data), bands)
    share = bad / len(data) if data else 0.0
    good = not failed and low <= ratio <= high and share <= bad_share
    return len(words), word_chars, sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeats, ratio, share, failed, good


def quality(docs: DataFrame, text: str = "text", bands=BANDS, chunk: int = CHUNK, bad_share: float = BAD_SHARE) -> DataFrame:
    """``docs`` with the counts, ratio, bad_chunk_share, base_failed and kept."""
    tune(docs.sparkSession)
    new = [x.split()[0] for x in _NEW.split(", ")]
    held = [c for c in docs.columns if c.lower() not in new]
    body = free_name(docs, "body")
    rows = docs.select(*[F.col(f"`{c}`") for c in held], F.col(f"`{text}`").cast("string").alias(body))
    schema = docs.sparkSession.createDataFrame([], _NEW).schema
    full = rows.drop(body).schema
    for field in schema:
        full = full.add(field)

    def run(batches):
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            found = list(zip(*[judge(x, compressor, bands, chunk, bad_share) for x in utf8(batch.column(len(held)))])) or [[]] * len(new)
            kinds = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(held))), *(pa.array(v, k) for v, k in zip(found, kinds))], names=[*held, *new])

    return rows.mapInArrow(run, full)
