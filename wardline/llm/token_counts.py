"""Token counts by whole tokens.

Which strings of the vocabulary encode alone as one token is proved once, by the library
itself. A text is cut where no token can reach across; cuts found among these strings
count one, and the library merges only the rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import doc_texts, text_buffer

SPACE = "▁"  # the vocabulary's sign for a space
RUNS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@dataclass(frozen=True)
class Settings:
    """``model`` is the path of the vocabulary (None: the public one); ``memo`` bounds the words a worker remembers."""

    model: str | None = None
    limit: int = 4096
    memo: int = 300_000


class _Counts(dict):
    """Tokens of words after ``lead``. It starts with the proved whole tokens; others are learned as they are met."""

    def __init__(self, proved: set[str], lead: str, extra: int, encode, bound: int):
        super().__init__(dict.fromkeys(proved, 1))
        self.lead, self.extra, self.encode, self.bound = lead, extra, encode, bound + len(proved)

    def __missing__(self, word: str) -> int:
        n = len(self.encode(self.lead + word)) - self.extra
        if len(self) < self.bound:  # the first words met are the frequent ones
            self[word] = n
        return n


class Counter:
    """Token counts of texts, equal to the library's.

    The cuts rest on two facts about the vocabulary, checked here: no token has a space
    sign after another character, and none has a line feed. So no merge crosses the
    beginning of a run of spaces, or a line feed. The library puts one space before a
    text, and changes nothing else of it.
    """

    def __init__(self, model: str | None = None, memo: int = 300_000):
        import public_tokenizers
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model or public_tokenizers.path("piece_bpe_32k.model"))
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.cuts = not any(SPACE in name.lstrip(SPACE) for name in names)
        self.lines = not any("\n" in name for name in names) and self.encode("a\nb") == [*self.encode("a"), *self.encode("\nb")[1:]]
        after_space = {n[1:] for n in names if n[:1] == SPACE and n[1:2] not in ("", SPACE)}
        bare = {n for n in names if n and SPACE not in n}
        whole = {n for n in after_space if len(self.encode(n)) == 1} | {""}  # a space alone
        # a space and a line feed before it count two
        alone = {n for n in bare if len(self.encode("\n" + n)) == 3} if self.lines else set()
        self.spaced = _Counts(whole, "", 0, self.encode, memo)
        self.bare = _Counts(alone, "\n", 2, self.encode, memo)

    def encode(self, text: str) -> list[int]:
        return self.library.encode(text, out_type=int)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.cuts:
            return len(self.encode(text))
        spaced = self.spaced.__getitem__
        odd = "  " in text or text[0] == " " or text[-1] == " " or SPACE in text
        if odd or not self.lines or " \n" in text or "\n " in text:
            return sum(map(spaced, [run[1:].replace(SPACE, " ") for run in RUNS.findall(SPACE + text.replace(" ", SPACE))]))
        total, first = 0, True
        for line in text.split("\n"):
            words = line.split(" ")
            if first:
                first = False
                total += spaced(words[0]) if words[0] else 1  # the space that the library adds
            else:
                total += 1 + (self.bare[words[0]] if words[0] else 0)
            total += sum(map(spaced, words[1:]))
        return total


@cache
def _counter(settings: Settings) -> Counter:
    """One for each worker process."""
    return Counter(settings.model, settings.memo)


def _counted(settings: Settings):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(settings)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            tokens = np.array([counter.count(t.as_py()) for t in texts], np.int64)
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(np.diff(text_buffer(texts)[1])), pa.array(tokens)], [*batch.schema.names[:-1], "n_bytes", "n_tokens"]
            )

    return count


def op2_token_counts(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Bytes and tokens of every whole text of ``docs`` (doc_id, text).

    Null and empty texts have none of either. Rows that repeat are counted each by
    itself; an empty table gives no rows.
    """
    counted = doc_texts(docs).mapInArrow(_counted(settings), "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > settings.limit)
