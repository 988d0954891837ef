"""Token counts that follow edits.

A document is a segment tree over runs of whole pre-tokens.  Its leaves hold
about ``LEAF`` characters and end before white space, or where letters, digits
and other characters meet; byte-level BPE always splits there, whatever stands
around, so the tokens of the leaves add up to those of the text.  Nodes hold the
sums of characters and tokens below them.

An edit finds its leaves by the sums of characters.  They are encoded again,
together with a neighbour if the edit touches the two characters that make
their border, and the sums on the paths to the root are updated.  Text that an
edit adds goes to the leaves that it touches; the tree is laid out anew only
when one of them has grown to ``GROWN`` leaves' size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .packing import encoder, vocabulary
from .storage import table

#: Characters of a leaf, at least.
LEAF = 256
#: Leaves' sizes that one leaf may grow to.
GROWN = 8
_W, _LN = r"\p{White_Space}", r"\p{L}\p{N}"
#: The last character before a border.  An apostrophe may start a contraction, and a bar stands inside special tokens, beside letters.
_BORDER = regex.compile(rf"[^{_W}](?={_W})|[{_LN}](?=[^{_W}{_LN}|])|[^{_W}{_LN}'|](?=[{_LN}])|\p{{L}}(?=\p{{N}})|\p{{N}}(?=\p{{L}})")


def split(text: str, leaf: int = LEAF) -> list[str]:
    """The text in leaves; a stretch without a border (letters alone, or white space alone) is one leaf, whatever its length."""
    out, at = [], 0
    while len(text) - at > leaf:
        m = _BORDER.search(text, at + leaf - 1)
        if m is None:
            break
        out.append(text[at : m.end()])
        at = m.end()
    return [*out, text[at:]]


class TokenTree:
    """Segment tree of one document; ``encode`` turns a list of texts into lists of ids."""

    def __init__(self, text: str, encode, leaf: int = LEAF):
        self.encode, self.leaf_size = encode, leaf
        self.encoded_chars = 0
        self._build(split(text, leaf))

    def _build(self, leaves: list[str], tokens: list[int] | None = None) -> None:
        self.leaves = leaves
        tokens = self._count(leaves) if tokens is None else tokens
        self.size = 1 << max(0, (len(leaves) - 1).bit_length())
        self.chars = np.zeros(2 * self.size, dtype=np.int64)
        self.tokens = np.zeros(2 * self.size, dtype=np.int64)
        self.chars[self.size : self.size + len(leaves)] = [len(x) for x in leaves]
        self.tokens[self.size : self.size + len(leaves)] = tokens
        for sums in (self.chars, self.tokens):
            level = self.size
            while level > 1:
                sums[level // 2 : level] = sums[level : 2 * level : 2] + sums[level + 1 : 2 * level : 2]
                level //= 2

    def _count(self, leaves: list[str]) -> list[int]:
        self.encoded_chars += sum(map(len, leaves))
        return [len(ids) for ids in self.encode(leaves)]

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    @property
    def n_chars(self) -> int:
        return int(self.chars[1])

    def locate(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character, and where it starts; past the end, the last leaf."""
        position = min(max(0, position), max(0, self.n_chars - 1))
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if position >= start + self.chars[node]:
                start += int(self.chars[node])
                node += 1
        return min(node - self.size, len(self.leaves) - 1), start

    def replace(self, start: int, stop: int, text: str) -> None:
        """Put ``text`` in the place of the characters from ``start`` to ``stop``; both are clipped to the document."""
        start = min(max(0, start), self.n_chars)
        stop = min(max(start, stop), self.n_chars)
        # a border is made by the characters on its two sides
        first, at = self.locate(start - 1)
        last, _ = self.locate(stop)
        old = "".join(self.leaves[first : last + 1])
        new = split(old[: start - at] + text + old[stop - at :], self.leaf_size)
        tokens = self._count(new)
        places = last - first + 1
        share = -(-len(new) // places)  # leaves in a row that take one place
        if share > 1 and max(sum(map(len, new[k : k + share])) for k in range(0, len(new), share)) > GROWN * self.leaf_size:
            # the other leaves keep their counts
            known = self.tokens[self.size : self.size + len(self.leaves)].tolist()
            self._build([*self.leaves[:first], *new, *self.leaves[last + 1 :]], [*known[:first], *tokens, *known[last + 1 :]])
            return
        for k in range(places):
            own = slice(k * share, (k + 1) * share)
            self._set(first + k, "".join(new[own]), sum(tokens[own]))

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        node = self.size + leaf
        chars, more = len(text) - int(self.chars[node]), tokens - int(self.tokens[node])
        while node:
            self.chars[node] += chars
            self.tokens[node] += more
            node //= 2


_EDITS = "array<struct<start:bigint,stop:bigint,text:string>>"


def count_edits(docs: DataFrame, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """``doc_id, n_tokens, n_tokens_after, n_chars_after, n_edits, n_chars_encoded`` of every row.

    ``docs`` has ``doc_id``, ``text`` and ``edits``, an array of structs
    ``start, stop, text`` that are applied in order, each to the text as the
    ones before it left it.  Positions are code points and are clipped to the
    text; null positions count as 0 and a null replacement as empty.  Null and
    empty texts have no tokens and can be edited.  ``n_chars_encoded`` counts
    the characters that the edits made the encoder read again.  Every row is
    returned, repeated rows and null ids too; very long texts are one tree; an
    empty table has no rows.  Other columns of ``docs`` are not returned, whatever
    their names.
    """
    path = path or vocabulary()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in hashing.slices(batches):
            rows = []
            for text, edits in zip(batch.column(1), batch.column(2), strict=True):
                tree = TokenTree(text.as_py() or "", encode, leaf)
                before, read = tree.n_tokens, tree.encoded_chars
                edits = edits.as_py() or []
                for e in edits:
                    tree.replace(e["start"] or 0, e["stop"] or 0, e["text"] or "")
                rows.append((before, tree.n_tokens, tree.n_chars, len(edits), tree.encoded_chars - read))
            r = np.array(rows, dtype=np.int64).reshape(-1, 5)
            names = ["n_tokens", "n_tokens_after", "n_chars_after", "n_edits", "n_chars_encoded"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(r[:, i]) for i in range(5)]], names=["doc_id", *names])

    schema = "doc_id bigint, n_tokens bigint, n_tokens_after bigint, n_chars_after bigint, n_edits bigint, n_chars_encoded bigint"
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.col("edits").cast(_EDITS)).mapInArrow(run, schema)


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs`` with the rows of an edit table (``doc_id, seq, start, stop, text``) as the ordered array that ``count_edits`` takes."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "start", "stop", F.col("text").alias("text")))), lambda e: F.struct(e["start"].alias("start"), e["stop"].alias("stop"), e["text"].alias("text")))
    per_doc = edits.groupBy("doc_id").agg(ordered.alias("edits"))
    return docs.drop("edits").join(per_doc, "doc_id", "left")


def query_edits(docs: DataFrame) -> DataFrame:
    """The query's edits of every document: a replacement, an insertion and a removal at places drawn from the id."""
    n = F.length(F.coalesce("text", F.lit(""))) + 1

    def place(seed: int):
        return F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), n)

    def edit(seed: int, width: int, text: str):
        return F.struct(place(seed).alias("start"), (place(seed) + width).alias("stop"), F.lit(text).alias("text"))

    return docs.withColumn("edits", F.array(edit(1, 12, "edited"), edit(2, 0, " a few new words, 2024 "), edit(3, 20, "")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_edits(query_edits(table(spark, sf_dir, "documents").select("doc_id", "text")))
