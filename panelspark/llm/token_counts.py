"""Token counts by the whole-token shortcut.

A byte-level tokenizer merges inside pre-tokens only, so a pre-token's ids do not depend on its neighbours. Once, before any text is
read, every string of the vocabulary is given to the library alone; the ones that are a single pre-token and come back as the single id they
stand for are whole. A text is then split into pre-tokens; those that are whole count one token each, by a look-up, and only
the distinct others are given to the library to be merged.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .tokens import PRE_TOKENS, added_tokens, encode_pieces, load, taken_whole

KEEP = 32 << 20  # bytes of merged pre-tokens that a task remembers; no effect on results


def prove_whole(path: str) -> frozenset[str]:
    """The strings that, as a pre-token of any text, are one token: a string of the vocabulary which is one pre-token and
    which the library encodes, alone, as its own id. Strings that are no valid UTF-8 come back as other ids and are left out."""
    tokenizer = load(path)
    special = set(added_tokens(tokenizer))
    ids = sorted(tokenizer.get_vocab(with_added_tokens=False).values())
    strings = [tokenizer.decoder.decode([tokenizer.id_to_token(i)]) for i in ids]
    alone = tokenizer.encode_batch(strings, add_special_tokens=False)
    return frozenset(s for i, s, e in zip(ids, strings, alone) if e.ids == [i] and s not in special and PRE_TOKENS.findall(s) == [s])


class TokenCounter:
    """Counts the tokens of texts. Remembers the sizes of pre-tokens it has merged, up to about ``keep`` bytes."""

    def __init__(self, path: str, whole: frozenset[str], keep: int = KEEP):
        self.tokenizer, self.whole, self.keep = load(path), whole, keep
        self.special = added_tokens(self.tokenizer)
        self.merged: dict[str, int] = {}
        self.held = 0

    def _merge(self, pieces: list[str]) -> None:
        """Has the library merge pre-tokens and remembers their sizes."""
        for a in range(0, len(pieces), 50_000):
            part = pieces[a : a + 50_000]
            self.merged.update(zip(part, encode_pieces(self.tokenizer, part)[0].tolist()))
        self.held += sum(map(len, pieces)) + 120 * len(pieces)

    def counts(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each text, and how many of them were counted by the shortcut. A null text is an empty one; a text that holds the
        string of an added token, or an odd character, goes to the library as it is."""
        total, direct = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        whole, rest = self.whole, {}
        for i, t in enumerate(texts):
            if not t:
                continue
            if taken_whole(t, self.special):
                total[i] = len(self.tokenizer.encode(t, add_special_tokens=False).ids)
                continue
            pieces = PRE_TOKENS.findall(t)
            rest[i] = [p for p in pieces if p not in whole]
            total[i] = direct[i] = len(pieces) - len(rest[i])
        if self.held > self.keep:
            self.merged, self.held = {}, 0
        self._merge(list({p for pieces in rest.values() for p in pieces} - self.merged.keys()))
        size = self.merged.__getitem__
        for i, pieces in rest.items():
            total[i] += sum(map(size, pieces))
        return total, direct


def count_tokens(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", limit: int = 1024, keep: int = KEEP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, n_direct) for every row of ``docs``, in no order.

    ``tokenizer`` is a byte-level BPE file of the tokenizers library; tokens are those of the library without added ones at the ends, its added
    tokens' strings inside a text being one token each. n_bytes is the text's length in UTF-8, over_limit tells whether it has more
    than ``limit`` tokens, n_direct how many were counted without merging (0 where the library took the text as it is).
    Null and empty texts have no bytes and no tokens; rows with a null id and repeated rows are answered once each; very long texts are counted whole; an
    empty table gives an empty result. Other columns of ``docs`` are not read, whatever their names.
    """
    whole = prove_whole(tokenizer)
    shared = docs.sparkSession.sparkContext.broadcast(whole)  # as long as the vocabulary at most
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), body.alias("t"))
    kind = plain.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(tokenizer, shared.value, keep)
        for batch in small_batches(batches, "t"):
            total, direct = counter.counts(batch.column("t").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(total), pa.array(total > limit), pa.array(direct)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_direct"],
            )

    return plain.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, n_direct long")
