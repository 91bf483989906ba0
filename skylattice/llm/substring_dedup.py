"""Substring dedup over words: De Bruijn paths of token k-mers, compacted to entries of their first sources."""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats

COLUMNS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
TEXT = pa.schema([*COLUMNS, ("kept_text", pa.string()), ("th", pa.int64())])


def substring_dedup(docs: DataFrame, window: int = 13, anchor: int = 7, keep_text: bool = False) -> DataFrame:
    """Remove every word covered by a window of ``window`` words that also starts in a document
    with a smaller doc_id.

    Windows are the edges of a De Bruijn graph on word k-mers. Occurrences that share an anchor
    form one path; a path that never branches is compacted to a single entry, branching ones are
    split into their edges (``repeats``). The source document travels with every entry, so the
    earliest one is known; identity is two 64-bit hashes, and words at the source are not read again.

    Words are ``[^\\x20\\x09-\\x0D]+``. Null text has no words. Documents shorter than the window
    lose nothing; very long texts are read whole, each by one task. Repeated rows (the same
    doc_id) never remove each other; rows without a doc_id come after all others. One row per
    input row, none for an empty table; other columns are ignored.

    Returns doc_id, n_words, n_removed, kept_sha256, and with ``keep_text`` kept_text (words joined by
    one space) and th (xxhash64 of the text), which with doc_id tells rows apart.
    """
    schema = TEXT if keep_text else COLUMNS

    def finish(block, intervals):
        rows = {c: [] for c in schema.names}
        if block is None:
            return pa.table(rows, schema=schema)
        gone = np.zeros(len(block.starts) + 1, np.int8)
        np.add.at(gone, intervals[:, 0], 1)
        np.add.at(gone, intervals[:, 1], -1)
        gone = np.cumsum(gone)[:-1] > 0
        raw = block.data.tobytes()
        for i, doc in enumerate(block.ids.tolist()):
            words, mask = raw[block.offsets[i] : block.offsets[i + 1]].split(), gone[block.bounds[i] : block.bounds[i + 1]]
            kept = b" ".join(compress(words, (~mask).tolist()) if mask.any() else words)
            rows["doc_id"].append(None if doc == repeats.NO_ID else doc)
            rows["n_words"].append(len(words))
            rows["n_removed"].append(int(mask.sum()))
            rows["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if keep_text:
                rows["kept_text"].append(kept.decode())
                rows["th"].append(int(block.ties[i]))
        return pa.table(rows, schema=schema)

    plan = repeats.Plan(window=window, k=min(anchor, window), words=True, within=False, block_bytes=1 << 20)
    kinds = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string, th long" * keep_text
    return repeats.find(docs.select("doc_id", "text"), plan, finish, kinds)
