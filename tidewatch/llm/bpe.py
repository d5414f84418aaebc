"""Whole texts to token ids with the tokenizers library, through a bounded cache of runs."""

from __future__ import annotations

import json
import os
from array import array
from functools import lru_cache

import numpy as np

from tidewatch.llm import text as T

#: Cached runs of a generation; two generations are kept, so that frequent runs outlast rare ones. About 130 MB a worker.
CACHE = 320_000
#: Bytes of text that are cut into runs at once; a longer text is cut in between.
CHUNK = 2 << 20
_SPACE, _LETTER, _DIGIT, _OTHER, _WORD, _END = range(6)
_BLANK, _BROKEN, _LAST = 1, 2, 3


def _classes() -> np.ndarray:
    """Class of each ASCII byte. _WORD: its whole word goes to the library (apostrophes, control characters, non-ASCII)."""
    out = np.full(256, _WORD, np.uint8)
    out[33:127] = _OTHER
    for lo, hi, kind in ((48, 58, _DIGIT), (65, 91, _LETTER), (97, 123, _LETTER)):
        out[lo:hi] = kind
    out[39] = _WORD
    out[T.SPACE] = _SPACE
    return out


_CLASS = _classes()


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable ones stand for themselves, the others for code points from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _ids(numbers: list[int]) -> bytes:
    return array("I", numbers).tobytes()


class Encoder:
    """Ids of whole texts; equal to encode(text, add_special_tokens=False).

    With a byte-level pre-tokenizer, runs of letters (ASCII and the accented ones of Latin-1), digits and signs, each with a
    blank before it, are pre-tokens, and so is white space without that blank. A batch is cut into runs by numpy, and each
    distinct run goes to the library's model once while it is cached. Words with other characters go to the library as
    they are; texts that hold an added token's string or a space outside ASCII, and those of any other tokenizer, whole.
    """

    def __init__(self, path: str, cache: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        made = json.loads(self.tokenizer.to_str())
        pre = made.get("pre_tokenizer") or {}
        self.by_run = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and made.get("normalizer") is None and made["model"]["type"] == "BPE"
        self.added = [t["content"].encode() for t in made.get("added_tokens") or []]
        self.letters = byte_letters()
        self.limit, self.young, self.old = cache, {}, {}

    def _whole(self, text: bytes) -> bytes:
        return _ids(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids)

    def _make(self, run: bytes, kind: int) -> bytes | None:
        """Ids of a run, its blank in front; None for a word with a space outside ASCII."""
        if kind == _WORD:
            inside = run.removeprefix(b" ").decode("utf-8", "replace")
            return None if any(c.isspace() and c not in "\x1c\x1d\x1e\x1f" for c in inside) else self._whole(run)
        if kind == _SPACE:
            return self._whole(run)
        letters = run.decode("latin-1").translate(self.letters)
        return _ids([t.id for t in self.model.tokenize(letters)])

    def _known(self, run: bytes, kind: int) -> bytes | None:
        found = self.young.get(run)
        if found is None:
            found = self.old.get(run)
            if found is None:
                found = self._make(run, kind)
                if found is None or len(run) > 256:
                    return found
            if len(self.young) >= self.limit:
                self.old, self.young = self.young, {}
            self.young[run] = found
        return found

    def _runs(self, w: T.Words) -> tuple[np.ndarray, ...]:
        """Starts, ends, classes and flags of all runs of the texts; an _END after each text."""
        buf = w.buf
        kind = _CLASS[buf]
        # an accented letter of Latin-1: 0xC3 and a continuation byte, but for the two signs among them
        lead = np.flatnonzero(buf[:-8] == 0xC3)
        after = buf[lead + 1]
        lead = lead[(after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
        odd = np.flatnonzero(kind == _WORD)
        if len(odd):
            which = np.unique(np.searchsorted(w.starts, odd, side="right") - 1)
            step = np.zeros(len(buf) + 1, np.int8)
            step[w.starts[which]] += 1
            step[w.ends[which]] -= 1
            kind[np.cumsum(step[:-1], dtype=np.int8) > 0] = _WORD
        kind[w.at + w.size] = _END
        kind[: w.at[0]] = _END
        kind = kind[: w.at[-1] + w.size[-1] + 1]
        first = np.concatenate([[0], np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == _END)) + 1])
        last = np.append(first[1:], len(kind))
        of, flag = kind[first], np.zeros(len(first), np.uint8)
        space = np.flatnonzero(of == _SPACE)
        inner = space[of[space + 1] != _END]
        blank = buf[last[inner] - 1] == 0x20
        flag[inner[blank] + 1] = _BLANK
        last[inner[blank]] -= 1
        flag[inner[~blank]] = _BROKEN
        flag[inner[~blank & (last[inner] - first[inner] == 1)]] = _LAST
        keep = (first < last) & (np.arange(len(first)) > 0)
        return first[keep], last[keep], of[keep], flag[keep]

    def _batch(self, texts: list[bytes], end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin and end among them."""
        w = T.words(texts)
        first, last, of, flag = self._runs(w)
        size = last - first
        rows = np.lib.stride_tricks.sliding_window_view(w.buf, 8)
        head = rows[first].view("<u8").ravel() & T.MASK[np.minimum(size, 8)]
        tail = rows[np.maximum(last - 8, first)].view("<u8").ravel() & T.MASK[np.minimum(size, 8)]
        mark = (size.astype(np.uint64) << np.uint64(4)) | (flag.astype(np.uint64) << np.uint64(1)) | (of == _END)
        h = T.mix(T.mix(head ^ T.mix(mark)) ^ tail)
        long = np.flatnonzero(size > 16)
        h[long] = T.mix(h[long] ^ T.hash_spans(w.buf, first[long], last[long]))
        order = np.argsort(h)
        new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
        group = np.empty(len(h), np.int64)
        group[order] = np.cumsum(new) - 1
        chosen = order[new]
        # runs of up to 16 bytes are equal if these are; of longer ones only the hash is compared
        same = (head == head[chosen][group]) & (tail == tail[chosen][group]) & (mark == mark[chosen][group])
        apart = np.flatnonzero(~same)
        group[apart] = len(chosen) + np.arange(len(apart))
        chosen = np.concatenate([chosen, apart])
        raw = w.buf.tobytes()
        begin = first[chosen] - (flag[chosen] == _BLANK)  # a run's blank stands before it
        runs = list(map(raw.__getitem__, map(slice, begin.tolist(), last[chosen].tolist())))
        ids = list(map(self.young.get, runs))
        odd = (of[chosen] == _END) | (flag[chosen] == _BROKEN)
        kinds = of[chosen]
        lost: list[int] = []
        for k in np.flatnonzero(odd | np.fromiter((x is None for x in ids), bool, len(ids))).tolist():
            run, kind = runs[k], int(kinds[k])
            if kind == _END:
                ids[k] = end
            elif odd[k]:  # the last space does not belong to what follows, and is a pre-token of its own
                ids[k] = self._known(run[:-1], kind) + self._known(run[-1:], kind)
            else:
                ids[k] = self._known(run, kind)
                if ids[k] is None:
                    lost.append(k)
                    ids[k] = b""
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        at = np.cumsum(n) - n
        many = n[group]
        before = np.cumsum(many) - many
        out = flat[np.repeat(at[group] - before, many) + np.arange(many.sum())]
        ends = np.flatnonzero(of == _END)
        bound = np.concatenate([[0], (before + many)[ends]])
        if not lost:
            return out, bound
        slow = set(np.searchsorted(ends, np.flatnonzero(np.isin(group, lost))).tolist())
        return _joined([np.frombuffer(self._whole(t) + end, "<u4") if i in slow else out[bound[i] : bound[i + 1]] for i, t in enumerate(texts)])

    def _parts(self, text: bytes):
        """Parts of a long text, each from a blank between two ASCII signs, letters or digits on."""
        lo = 0
        while len(text) - lo > CHUNK:
            at = lo + CHUNK
            while True:
                at = text.find(b" ", at, len(text) - 1)
                if at < 0 or 32 < text[at - 1] < 127 and 32 < text[at + 1] < 127:
                    break
                at += 1
            if at < 0:
                break
            yield text[lo:at]
            lo = at
        yield text[lo:]

    def many(self, texts: list[bytes | None], end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all texts one after the other, each followed by end; and the bounds of each. Null is empty."""
        out: list[np.ndarray] = [np.zeros(0, "<u4")]
        size: list[int] = []
        texts = [t or b"" for t in texts]
        for lo, hi in _chunks(texts):
            part = texts[lo:hi]
            whole = [not self.by_run or any(x in t for x in self.added) for t in part]
            if len(part) == 1 and len(part[0]) > CHUNK and not whole[0]:
                pieces = [self._batch([p], b"")[0] for p in self._parts(part[0])]
                out += [*pieces, np.frombuffer(end, "<u4")]
                size.append(sum(map(len, pieces)) + len(end) // 4)
                continue
            ids, bound = self._batch([b"" if x else t for x, t in zip(whole, part, strict=True)], end)
            if any(whole):
                ids, bound = _joined([np.frombuffer(self._whole(t) + end, "<u4") if x else ids[bound[i] : bound[i + 1]] for i, (x, t) in enumerate(zip(whole, part, strict=True))])
            out.append(ids)
            size += np.diff(bound).tolist()
        return np.concatenate(out), np.concatenate([[0], np.cumsum(size, dtype=np.int64)]).astype(np.int64)

    def __call__(self, text: str) -> bytes:
        return self.many([text.encode("utf-8", "surrogatepass")])[0].tobytes()


def _chunks(texts: list[bytes]):
    """Index ranges of texts with at most CHUNK bytes each; a longer text is alone."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > CHUNK:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process, so that its cache outlasts a task."""
    return Encoder(path)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
