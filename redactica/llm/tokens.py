"""Token ids of whole texts by a public byte-level BPE file.

Words repeat far more than texts do, so they are encoded once and remembered, up to a bound. The tokenizer never merges across the
places where its splitting rule cuts, and the rule cuts before every single blank and line break. So a text with single blanks and
breaks only is the sum of its words, each with the blank before it, and of its line breaks. Such texts are taken apart and put
together again as arrays: words are known by a 128-bit hash and their ids lie in one pool. Texts with other white space are cut by the
rule itself. Texts with characters beyond the Latin blocks or control characters, where the rule of two libraries might differ, and
texts with the string of a special token go to the tokenizer whole.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np

from redactica.llm.common import word_hashes

#: Words that a worker remembers; beyond it the memory starts anew.
REMEMBERED = 800_000
#: Words that are encoded as one text.
JOINED = 500
#: Texts that are taken apart at once.
AT_ONCE = 500
_BEYOND = re.compile("[^\t-\r\x20-\x7e\xa0-\u024f]")
_RARE_SPACE = re.compile("[\t\x0b-\r\xa0]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut: dict[str, bytes] = {}
        self.line_break = np.frombuffer(self._alone(["\n"])[0], "<u4")
        self._forget()

    def _forget(self) -> None:
        self.key, self.proof = np.zeros(0, np.uint64), np.zeros(0, np.uint64)  # hashes of the words known, sorted by the first
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)  # where their ids lie in the pool
        self.pool = np.zeros(0, "<u4")

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _new(self, words: list[str]) -> list[bytes]:
        """The ids of words that begin with a blank or a letter. Those of letters, or letters and a mark, are encoded joined: the
        rule cuts them apart again, at places that are known."""
        out: list[bytes] = [b""] * len(words)
        kinds: dict[int, list[int]] = {1: [], 2: [], 3: [], 0: []}
        for i, w in enumerate(words):
            own = w[1:] if w[0] == " " else w
            if own.isalpha():
                kinds[1 if w[0] == " " else 3].append(i)
            else:
                kinds[2 if w[0] == " " and own[-1] in ".,;:!?" and own[:-1].isalpha() else 0].append(i)
        for each, lead, own in ((1, "", kinds[1]), (2, "", kinds[2]), (2, "\n", kinds[3])):
            for k in range(0, len(own), JOINED):
                part = own[k : k + JOINED]
                e = self.tokenizer.encode("".join([lead + words[i] for i in part]), add_special_tokens=False)
                starts = np.flatnonzero(np.diff(np.array(e.word_ids), prepend=-1))
                if len(starts) != each * len(part):
                    kinds[0] += part
                    continue
                ids, ends = np.array(e.ids, "<u4").tobytes(), [*(4 * starts[::each][1:]).tolist(), 4 * len(e.ids)]
                for i, a, b in zip(part, (4 * starts[each - 1 :: each] if lead else 4 * starts[::each]).tolist(), ends, strict=True):
                    out[i] = ids[a:b]
        for i, b in zip(kinds[0], self._alone([words[i] for i in kinds[0]]), strict=True):
            out[i] = b
        return out

    def _by_rule(self, text: str) -> bytes:
        if len(self.cut) > REMEMBERED // 4:
            self.cut.clear()
        words, cut = self.split(text), self.cut
        if new := list({w for w in words if w not in cut}):
            cut.update(zip(new, self._alone(new), strict=True))
        return b"".join([cut[w] for w in words])

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Texts without white space at their ends or two in a row."""
        encoded = [t.encode() for t in texts]
        data = b"\n".join([b"", *encoded, b"", b"12345678"])
        raw = np.frombuffer(data, np.uint8)
        space = (raw == 32) | (raw == 10)
        starts = np.flatnonzero(space[:-1] & ~space[1:])[:-1] + 1
        ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        a, b = word_hashes(data, starts, ends - starts)
        blank = raw[starts - 1] == 32
        a ^= np.where(blank, np.uint64(0x5851F42D4C957F2D), np.uint64(0))
        keys, first, word = np.unique(a, return_index=True, return_inverse=True)
        proof = b[first]
        if (proof[word] != b).any():
            return [self._by_rule(t) for t in texts]
        if len(self.key) > REMEMBERED:
            self._forget()
        place = np.searchsorted(self.key, keys)
        known = place < len(self.key)
        known[known] = self.key[place[known]] == keys[known]
        new = np.flatnonzero(~known)
        if new.size:
            lead = blank[first[new]]
            spans = zip(starts[first[new]].tolist(), ends[first[new]].tolist(), lead.tolist(), strict=True)
            ids = self._new([data[s - x : e].decode() for s, e, x in spans])
            size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            at = len(self.pool) + np.cumsum(size) - size
            self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(ids), "<u4")])
            where = place[new]
            self.key, self.proof = np.insert(self.key, where, keys[new]), np.insert(self.proof, where, proof[new])
            self.at, self.size = np.insert(self.at, where, at), np.insert(self.size, where, size)
            place = np.searchsorted(self.key, keys)
        if (self.proof[place] != proof).any():
            return [self._by_rule(t) for t in texts]
        offsets = np.cumsum([1, *(len(e) + 1 for e in encoded)])
        opens = np.searchsorted(starts, offsets[:-1])  # the first word of each text
        broken = ~blank
        broken[opens] = False
        own = self.size[place][word]
        total = own + broken
        ends = np.cumsum(total)
        begin = ends - own
        out = np.full(int(ends[-1]), self.line_break[0], "<u4")
        inner = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
        out[inner + np.repeat(begin, own)] = self.pool[inner + np.repeat(self.at[place][word], own)]
        cuts = [*(ends - total)[opens].tolist(), len(out)]
        return [out[x:y].tobytes() for x, y in zip(cuts, cuts[1:], strict=False)]

    def many(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        whole, plain = [], []
        for i, t in enumerate(texts):
            if not t:
                continue
            if _BEYOND.search(t) or any(s in t for s in self.special):
                whole.append(i)
            elif "  " in t or "\n\n" in t or " \n" in t or "\n " in t or t[0] in " \n" or t[-1] in " \n" or _RARE_SPACE.search(t):
                out[i] = self._by_rule(t)
            else:
                plain.append(i)
        for i, ids in zip(whole, self._alone([texts[i] for i in whole]), strict=True):
            out[i] = ids
        for k in range(0, len(plain), AT_ONCE):
            part = plain[k : k + AT_ONCE]
            for i, ids in zip(part, self._plain([texts[i] for i in part]), strict=True):
                out[i] = ids
        return out


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker and file."""
    return Encoder(path)
