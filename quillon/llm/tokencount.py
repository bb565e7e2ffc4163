"""Edit-aware token counts: a tree of counts over each document's pre-tokens, re-encoded only where edits touch."""

from __future__ import annotations

import re

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import CONTROLS, Encoder, encoder

#: Characters of a leaf, at least; a leaf ends where a pre-token must.
LEAF = 256
#: An edited leaf may grow to so many before the tree is laid out anew.
LARGE = 16 * LEAF
#: A space before what is surely no white space starts a pre-token, and no special token spans it.
START = re.compile(f" (?=[^\\s{CONTROLS.pattern[1:-1]}])")
#: The edits of the query: at these shares of the text so many characters are replaced.
EDITS = ((1, 4, 12, "changed"), (1, 2, 0, " inserted words"), (3, 4, 9, ""))


class Counted:
    """A document whose token count stays right under edits; leaves hold text, inner nodes sums of counts and sizes.

    encoded and looked count the characters that were encoded and that were looked at in any way.
    """

    def __init__(self, text: str, codec: Encoder):
        self.codec, self.encoded, self.looked = codec, 0, 0
        # special tokens that hold a space might span leaves: with such a vocabulary a text is one leaf
        self.whole = any(" " in x for x in codec.special)
        leaves = self._leaves(text)
        self._build(leaves, [self._count(x) for x in leaves])

    def _leaves(self, text: str) -> list[str]:
        self.looked += len(text)
        out, at = [], 0
        while not self.whole and (m := START.search(text, at + LEAF)):
            out.append(text[at : m.start()])
            at = m.start()
        return [*out, text[at:]]

    def _count(self, text: str) -> int:
        self.encoded += len(text)
        return len(self.codec.encode(text)) // 4

    def _build(self, leaves: list[str], counts: list[int]) -> None:
        self.leaves = leaves
        self.width = 1 << max(0, (len(leaves) - 1).bit_length())
        pad = [0] * (self.width - len(leaves))
        self.tokens = [0] * self.width + counts + pad
        self.sizes = [0] * self.width + [len(x) for x in leaves] + pad
        for i in range(self.width - 1, 0, -1):
            self._add(i)

    def _add(self, i: int) -> None:
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
        self.sizes[i] = self.sizes[2 * i] + self.sizes[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.sizes[1]

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def _leaf_at(self, at: int) -> int:
        """The leaf that holds character `at`; after the end, the last leaf that holds any."""
        i = 1
        while i < self.width:
            i *= 2
            if at >= self.sizes[i] and self.sizes[i + 1]:
                at -= self.sizes[i]
                i += 1
        return i - self.width

    def _start(self, leaf: int) -> int:
        i, start = self.width + leaf, 0
        while i > 1:
            start += self.sizes[i - 1] if i % 2 else 0
            i //= 2
        return start

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces characters start to end: encodes the leaves it touches and, at a boundary, those it meets.

        The new text's leaves take the places of the old ones in the tree, so only the sums above them change; what
        does not fit goes into the last of them. A leaf that has grown too large is cut up and the tree laid out
        anew over the counts, without a look at the other leaves' texts.
        """
        start = max(0, min(start, self.n_chars))
        end = max(start, min(end, self.n_chars))
        first, last = self._leaf_at(max(0, start - 1)), self._leaf_at(max(end + 1, start))
        begins = self._start(first)
        old = "".join(self.leaves[first : last + 1])
        made = self._leaves(old[: start - begins] + new + old[end - begins :])
        room = last - first + 1
        if sum(map(len, made[room - 1 :])) <= LARGE:
            made = [*made[: room - 1], "".join(made[room - 1 :])]
            for k, x in enumerate(made + [""] * (room - len(made)), first):
                self.leaves[k] = x
                i = self.width + k
                self.tokens[i], self.sizes[i] = self._count(x) if x else 0, len(x)
                while i := i // 2:
                    self._add(i)
        else:
            own = self.tokens[self.width : self.width + len(self.leaves)]
            self._build([*self.leaves[:first], *made, *self.leaves[last + 1 :]], [*own[:first], *map(self._count, made), *own[last + 1 :]])


def counts(docs: DataFrame, path: str | None = None, edits=EDITS) -> DataFrame:
    """doc_id, n_chars, n_tokens, edited_chars, edited_tokens and reencoded_chars for every row of docs (doc_id, text).

    The edits (share's numerator and denominator, characters replaced, new text) are applied one after the other
    to the counted tree; reencoded_chars is what they made it encode again. Null texts count as empty; repeated
    rows and null doc_ids keep a row each; other columns are not read.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches):
        codec = encoder(path)
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                own = Counted(t or "", codec)
                before, first = (own.n_chars, own.n_tokens), own.encoded
                for num, den, n, new in edits:
                    at = own.n_chars * num // den
                    own.edit(at, at + n, new)
                out.append((*before, own.n_chars, own.n_tokens, own.encoded - first))
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "n_chars", "n_tokens", "edited_chars", "edited_tokens", "reencoded_chars"])
        encoder(path).forget()

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n_chars long, n_tokens long, edited_chars long, edited_tokens long, reencoded_chars long")
