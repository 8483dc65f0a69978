"""Token ids of whole texts by the tokenizers library, with the ids of repeated chunks kept.

Both tokenizers used here split a text at white space before they merge, and none of their normal forms reaches across a space. So
a text cut before each single space between two other characters yields parts that encode by
themselves as they do in place. A text of any other shape, such as two spaces in a row, is encoded whole.

A chunk is cut once more, before its last full stops or commas, where the character before them is a letter or digit in ``_PLAIN``: there the tokenizers
split, too. Beyond those, a letter's normal form may end in a mark that joins the stops (``\u0130`` becomes ``i`` and a combining dot), so such
chunks are encoded as they are. ``tests/llm/test_tokens.py`` holds all this against whole texts, odd characters included.
"""

from __future__ import annotations

import functools
from array import array


#: Letters and digits up to U+024F whose lower case is one letter or digit: no mark is left at their end.
_PLAIN = frozenset(x for x in map(chr, range(0x250)) if x.isalnum() and len(x.lower()) == 1)


class ChunkEncoder:
    """``encode(text)`` gives the ids as unsigned 32-bit integers in the machine's order, in bytes.

    ``space_leads``: a chunk's ids depend on the space before it. ``most`` bounds the kept
    chunks: when so many are known they become the older half, from which those still in use come back.
    """

    def __init__(self, path: str, space_leads: bool, most: int = 900_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.lead, self.most = Tokenizer.from_file(path), " " if space_leads else "", most
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks that aren't known. A chunk with stops behind a word that was never met before is not kept, only the word: most such words stay rare."""
        known, older, tails, split, plain, got = self.known, self.older, self.tails, [], [], {}
        for chunk in chunks:
            ids = older.get(chunk)
            if ids is not None:
                known[chunk] = got[chunk] = ids
                continue
            core = chunk.rstrip(".,")
            if len(core) < len(chunk) and core and core[-1] in _PLAIN:
                ids = known.get(core) or older.get(core)
                split.append((chunk, core, chunk[len(core) :], ids is not None))
                if ids is None:
                    plain.append(core)
                else:
                    known[core] = ids
            else:
                plain.append(chunk)
        plain = list(set(plain))
        fresh = dict(zip(plain, self._ids([self.lead + c for c in plain] if self.lead else plain)))
        known.update(fresh)
        got.update(fresh)
        for chunk, core, tail, met in split:
            if tail not in tails:
                if len(tails) > 1000:
                    tails.clear()
                tails[tail] = self._ids([tail])[0]
            got[chunk] = known[core] + tails[tail]
            if met:
                known[chunk] = got[chunk]
        return got

    def _head(self, head: str) -> bytes:
        """A text's first chunk, which has no space before it."""
        ids = self.heads.get(head)
        if ids is None:
            if len(self.heads) > 20_000:
                self.heads.clear()
            ids = self.heads[head] = self._ids([head])[0]
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of one whole text; null is empty."""
        if not text:
            return b""
        chunks = text.split(" ")
        head = chunks.pop(0) if self.lead else ""
        if self.lead and (not head or head[0].isspace() or head[-1].isspace()):
            return self._ids([text])[0]
        found = [*map(self.known.get, chunks)]
        if None in found:
            if len(self.known) > self.most:
                self.known, self.older = {}, self.known
                found = [None] * len(chunks)
            lost = [i for i, f in enumerate(found) if f is None]
            new = {chunks[i] for i in lost}
            if len(new) > self.most or any(not c or c[0].isspace() or c[-1].isspace() for c in new):
                return self._ids([text])[0]
            learnt = self._learn([*new])
            for i in lost:
                found[i] = learnt[chunks[i]]
        return (self._head(head) if head else b"") + b"".join(found)

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        return [*map(self.encode, texts)]


@functools.lru_cache(maxsize=4)
def encoder(path: str, space_leads: bool) -> ChunkEncoder:
    """One for each Python worker, so the kept chunks last from batch to batch."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return ChunkEncoder(path, space_leads)
