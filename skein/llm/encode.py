"""Encoding of the corpus with a public byte-level BPE tokenizer, by DuckDB recursive queries per partition.

A text is cut into words by the tokenizer's pattern. The distinct words of a batch become token-position rows, first one
row per byte. A recursive query joins neighbouring tokens with the merge table, takes each word's pair of least rank,
contracts it at its leftmost place and, as no contraction makes a pair of lower rank than its own, in the same step at all
further places from left to right, and goes on with the words that still had a pair, until none has; an ordered aggregation
gives each word's ids. Words known from earlier batches of the partition aren't asked again. Nothing is shuffled.

A recursive query keeps the rows of all its steps, so words go in chunks of bounded rows. A word has as many steps as
different pairs were contracted, so even one of many thousand bytes without a break has few.

The tokenizer's file is a parameter; the driver reads it and broadcasts it (2 MB, fixed size).

Edge cases: null, empty -> empty list; strings that look like special tokens are ordinary text; lone surrogates can't
occur in Spark strings; very long texts are handled word by word; repeated ids are encoded alike; an empty table gives an
empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import ship

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the word pattern of this family of tokenizers.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows of a recursive query, and steps reckoned with at most; words remembered; texts encoded at a time.
ROWS, STEPS, CACHE, BATCH = 2_000_000, 400, 200_000, 10_000

SQL = """
with recursive t(step, w, pos, id) as (
  select 0, w, pos, id from start
  union all
  (with pair as (select w, pos, id, lead(id) over s as right_id, lead(pos) over s as right_pos, row_number() over s as o from t window s as (partition by w order by pos)),
        found as (select p.w, p.pos, p.right_pos, p.o, m.rank, m.id as merged, p.id = p.right_id as same from pair p join merges m on p.id = m.left_id and p.right_id = m.right_id),
        least as (select w, min(rank) as rank from found group by w),
        best as (select f.w, f.pos, f.right_pos, f.merged, f.o, f.same from found f join least l on f.w = l.w and f.rank = l.rank),
        run as (select w, pos, right_pos, merged, o, o - row_number() over (partition by w order by o) as g from best where same),
        chosen as (select w, pos, right_pos, merged from best where not same union all select w, pos, right_pos, merged from run qualify row_number() over (partition by w, g order by o) % 2 = 1),
        change as (select w, pos, merged from chosen union all select w, right_pos, -1 from chosen)
   select t.step + 1, t.w, t.pos, coalesce(c.merged, t.id)
   from t join least l on l.w = t.w left join change c on c.w = t.w and c.pos = t.pos
   where c.merged is null or c.merged >= 0)
)
select w, list(id order by pos) as ids from t join (select w, max(step) as step from t group by w) using (w, step) group by w
"""


def merge_table(path: str = TOKENIZER) -> tuple[list[int], list[tuple[int, int, int, int]]]:
    """Ids of the 256 bytes, and (rank, left, right, merged) of each merge."""
    model = json.loads(open(path, encoding="utf-8").read())["model"]
    vocab = model["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(plain))}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return [vocab[letter[b]] for b in range(256)], [(r, vocab[a], vocab[b], vocab[a + b]) for r, (a, b) in enumerate(pairs)]


class Encoder:
    """Encodes words; one per Python worker."""

    def __init__(self, first: list[int], merges: list[tuple[int, int, int, int]]) -> None:
        import duckdb
        import pyarrow as pa
        import regex

        self.first, self.words = first, regex.compile(PATTERN)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        rank, left, right, merged = zip(*merges, strict=True)
        table = pa.table({"rank": pa.array(rank, pa.int64()), "left_id": pa.array(left, pa.int32()), "right_id": pa.array(right, pa.int32()), "id": pa.array(merged, pa.int32())})
        self.db.register("given", table)
        self.db.execute("create table merges as select * from given")
        self.db.unregister("given")
        self.known: dict[str, list[int]] = {}

    def by_query(self, words: list[bytes]) -> list[list[int]]:
        import numpy as np
        import pyarrow as pa

        size = np.array([len(w) for w in words])
        which = np.repeat(np.arange(len(words), dtype=np.int32), size)
        pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        ids = np.array(self.first, dtype=np.int32)[np.frombuffer(b"".join(words), dtype=np.uint8)]
        self.db.register("start", pa.table({"w": which, "pos": pos.astype(np.int64), "id": ids}))
        out = self.db.execute(SQL).fetchall()
        self.db.unregister("start")
        found: list[list[int]] = [[]] * len(words)
        for w, x in out:
            found[w] = x
        return found

    def learn(self, words: set[str]) -> None:
        """Adds the ids of the words not yet known. ``words`` are all words of a batch, as those known may be dropped first."""
        if len(self.known) > CACHE:
            self.known.clear()
        new = sorted(((w.encode("utf-8", "surrogatepass"), w) for w in words if w not in self.known), key=lambda x: len(x[0]))
        chunk: list[tuple[bytes, str]] = []
        rows = 0

        def flush() -> None:
            if chunk:
                for (_, w), ids in zip(chunk, self.by_query([b for b, _ in chunk]), strict=True):
                    self.known[w] = ids
                chunk.clear()

        for b, w in new:
            need = len(b) * (min(len(b), STEPS) // 2 + 1)
            if rows + need > ROWS:
                flush()
                rows = 0
            chunk.append((b, w))
            rows += need
        flush()

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.words.findall(t) if t else [] for t in texts]
        out: list[list[int]] = []
        for i in range(0, len(cut), BATCH):
            part = cut[i : i + BATCH]
            self.learn({w for words in part for w in words})
            known = self.known
            out += [[x for w in words for x in known[w]] for words in part]
        return out


_ENCODERS: dict[int, Encoder] = {}


def encoded(df: DataFrame, id: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """(id, ids): the token ids of every text, without special tokens."""
    ship(df.sparkSession)
    given = df.sparkSession.sparkContext.broadcast(merge_table(path))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if given.value is None:
            return
        key = hash((tuple(given.value[0]), len(given.value[1]), given.value[1][-1]))
        if key not in _ENCODERS:
            _ENCODERS[key] = Encoder(*given.value)
        for pdf in frames:
            yield pd.DataFrame({"id": pdf["id"], "ids": _ENCODERS[key].encode(pdf["text"].tolist())})

    kind = df.schema[id].dataType.simpleString()
    return df.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInPandas(run, f"id {kind}, ids array<int>")
