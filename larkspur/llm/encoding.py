"""Exact tokenizer results in batches: distinct pieces go to the library, once.

A cut is safe before a space or a line feed whose neighbours are no white space:
byte-level pre-tokenizers attach such a space to the word after it and keep the
line feed alone, and the word-end tokenizer drops both, so no token spans the
cut and the library's result for a text is the concatenation of its results for
the pieces. Special strings hold no white space and so stay in one piece. In
text without spaces, a cut is also safe behind a full-width stop or comma between
two letters. This holds for tokenizers whose rules :func:`cuts_are_safe` knows;
for any other one, whole texts go to the library.
"""

from __future__ import annotations

import ctypes
import gc
import json
import os
import re
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from larkspur.llm.common import by_bytes

#: Pieces that a worker process remembers (about 60 bytes each, in Arrow), and the
#: longest one remembered, in characters. When there are more, all are forgotten.
CACHE_PIECES, CACHE_CHARS = 500_000, 64
#: Pieces at the start of a text that it remembers.
CACHE_FIRST = 50_000
#: Ids that the memory may hold.
CACHE_IDS = 1 << 24
#: Seconds without a batch after which an encoder forgets.
IDLE = 3
#: Bytes given to the library at once.
BATCH_BYTES = 1 << 18

# The rules of public tokenizers under which the cuts are safe.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_LEVEL = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _WORDS}, "behavior": "Removed", "invert": True}, {**_BYTE_LEVEL, "use_regex": False}]}
_WORD_FORM = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}

# Fixed value: how the byte-level alphabet writes a space.
SPACE = "\u0120"

#: A line feed between two characters that are no white space.
_LINE = re.compile(r"(?<=\S)(?=\n\S)")
#: Behind a full-width stop or comma that stands between two letters.
_STOP = re.compile("(?<=[^\\W\\d_][。，])(?=[^\\W\\d_])")


def load(path: str):
    """A ``tokenizers`` or ``sentencepiece`` tokenizer by file ending."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def rules_of(tokenizer) -> dict | None:
    """The tokenizer's rules without vocabulary and merges, None if it has no such."""
    if not hasattr(tokenizer, "to_str"):
        return None
    rules = json.loads(tokenizer.to_str())
    rules["model"] = {k: v for k, v in rules["model"].items() if k not in ("vocab", "merges")}
    return rules


def cuts_are_safe(rules: dict | None) -> bool:
    """Whether normaliser, pre-tokenizer and special strings are ones that the cuts are made for."""
    if rules is None:
        return False
    form = rules["normalizer"], rules["pre_tokenizer"]
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not re.search(r"\s", t["content"]) for t in rules["added_tokens"])
    whole = rules["truncation"] is None and rules["padding"] is None and not rules["model"].get("dropout")
    return plain and whole and form in ((None, _BYTE_LEVEL), (_WORD_FORM, _WORD_LEVEL))


def _edge(piece: str) -> bool:
    """Whether a space beside the piece may be no safe cut."""
    return not piece or piece[0].isspace() or piece[-1].isspace()


def units(text: str) -> list[str]:
    """The text cut wherever it is safe: each later unit begins with the space or
    line feed that it was cut before, or, behind a full-width stop, with a letter."""
    out: list[str] = []
    for i, part in enumerate(text.split(" ")):
        if i and part and not part[0].isspace() and out[-1] and not out[-1][-1].isspace():
            out.append(" " + part)
        elif out:
            out[-1] += " " + part
        else:
            out.append(part)
    shorter: list[str] = []
    for unit in out:
        for line in _LINE.split(unit) if len(unit) > CACHE_CHARS else [unit]:
            shorter += _STOP.split(line) if len(line) > CACHE_CHARS else [line]
    return shorter


class Encoder:
    """Ids, or their number only, of batches of texts.

    A batch is split at its spaces and its distinct pieces are found in Arrow;
    those not met before go to the library in batches of about equal bytes. The
    ids of a text are then gathered by numpy. A piece has a number: where its ids
    start in one array, and how many there are. Number 0 marks a piece that is
    cut again, with its text, by :func:`units`; number 1 is the id that ends a text.
    """

    def __init__(self, path: str, keep_ids: bool) -> None:
        self.tokenizer, self.keep_ids = load(path), keep_ids
        self.uses, self.timer = 0, None
        rules = rules_of(self.tokenizer)
        self.safe = cuts_are_safe(rules)
        self.mark, self.mark_id, self.has_mark, self.opens = "", -1, None, None
        if self.safe and rules["pre_tokenizer"] == _BYTE_LEVEL:
            words = self.tokenizer.get_vocab()
            self.opens = np.zeros(max(words.values()) + 1, dtype=bool)
            self.opens[[k for word, k in words.items() if word[0] == SPACE]] = True
        if self.safe and (special := self.tokenizer.get_added_tokens_decoder()):
            self.mark_id = min(special)
            self.mark = special[self.mark_id].content
            self.has_mark = re.compile("|".join(re.escape(t.content) for t in special.values())).search
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.string())  # pieces, without the space before them but with a line feed
        self.code = np.zeros(0, np.int32)  # their numbers
        self.first: dict[str, int] = {}  # numbers of pieces at the start of a text
        self.count, self.used = 2, 1
        self.n, self.start = np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.n[1] = 1
        self.pool = np.zeros(1024, np.uint32)

    def _ask(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each has."""
        n, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for run in by_bytes(texts, BATCH_BYTES):
            if self.opens is not None and (told := self._by_spaces(run)):
                ids.append(told[0])
                n.append(told[1])
                continue
            if not hasattr(self.tokenizer, "encode_batch_fast"):
                made = self.tokenizer.encode(run, num_threads=1)
            elif self.mark and not any(self.has_mark(t) for t in run):
                # special strings part a text before anything else, so they part these texts from each other
                joined = np.array(self.tokenizer.encode_batch_fast([self.mark.join(run)], add_special_tokens=False)[0].ids, dtype=np.uint32)
                marks = joined == self.mark_id
                at = np.concatenate([[-1], np.nonzero(marks)[0], [len(joined)]])
                n.append(np.diff(at) - 1)
                ids.append(joined[~marks])
                continue
            else:
                made = [e.ids for e in self.tokenizer.encode_batch_fast(run, add_special_tokens=False)]
            n.append(np.fromiter(map(len, made), np.int64, len(made)))
            ids.append(np.fromiter(chain.from_iterable(made), np.uint32))
        return np.concatenate(ids), np.concatenate(n)

    def _by_spaces(self, run: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and their numbers, from one text of all pieces, if each has one space, its first character.

        The cuts between them are safe, and a byte-level token that begins with
        the letter of a space begins a piece; None if these are not as many as the pieces.
        """
        text = "".join(run)
        if text.count(" ") != len(run) or not all(t[0] == " " for t in run):
            return None
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
        at = np.nonzero(self.opens[ids])[0]
        if len(at) != len(run) or at[0]:
            return None
        return ids, np.diff(np.append(at, len(ids)))

    def _learn(self, pieces: list[str]) -> np.ndarray:
        """New numbers for the pieces."""
        ids, n = self._ask(pieces)
        self.n, self.start = _grown(self.n, self.count, len(n)), _grown(self.start, self.count, len(n))
        new = np.arange(self.count, self.count + len(n), dtype=np.int32)
        self.n[new] = n
        self.count += len(n)
        if self.keep_ids:
            self.start[new] = self.used + np.cumsum(n) - n
            self.pool = _grown(self.pool, self.used, len(ids))
            self.pool[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
        return new

    def _numbers(self, keys: pa.StringArray, careful: bool = False) -> np.ndarray:
        """The numbers of distinct pieces. Unless they come from :func:`units`, those
        that are no safe cuts, or worth cutting further, get 0."""
        code = np.full(len(keys), -1, np.int32)
        if len(self.known):
            at = pc.index_in(keys, value_set=self.known).fill_null(-1).to_numpy()
            code[at >= 0] = self.code[at[at >= 0]]
        new = np.nonzero((code < 0) | (careful & (code == 0)))[0]
        words = _strings(keys.take(pa.array(new)))
        odd = np.fromiter((_edge(w) or len(w) > CACHE_CHARS for w in words), bool, len(words))
        unmet = code[new] < 0
        code[new] = 0
        asked = np.ones(len(words), dtype=bool) if careful else ~odd
        code[new[asked]] = self._learn([w if w[0] == "\n" else " " + w for w, ask in zip(words, asked.tolist(), strict=True) if ask])
        kept = unmet & (~odd if careful else np.fromiter((len(w) <= CACHE_CHARS for w in words), bool, len(words)))
        self.known = pa.concat_arrays([self.known, keys.take(pa.array(new[kept]))])
        self.code = np.concatenate([self.code, code[new[kept]]])
        return code

    def _first_numbers(self, pieces: list[str]) -> np.ndarray:
        got = list(map(self.first.get, pieces))
        missing = list(dict.fromkeys(p for p, k in zip(pieces, got, strict=True) if k is None))
        found = dict(zip(missing, self._learn(missing).tolist(), strict=True))
        if len(self.first) < CACHE_FIRST:
            self.first.update((p, k) for p, k in found.items() if len(p) <= CACHE_CHARS)
        return np.array([found[p] if k is None else k for p, k in zip(pieces, got, strict=True)], dtype=np.int32)

    def _careful_numbers(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of each text's units."""
        cut = [units(t) for t in texts]
        later = [u for row in cut for u in row[1:]]
        out = np.empty(len(later), np.int32)
        led = np.array([u[0] in " \n" for u in later], dtype=bool)
        keys = pa.array([u[1:] if u[0] == " " else u for u in later if u[0] in " \n"], pa.string()).dictionary_encode()
        out[led] = self._numbers(keys.dictionary, careful=True)[keys.indices.to_numpy()]
        out[~led] = self._learn([u for u in later if u[0] not in " \n"])
        ends = np.cumsum([len(row) - 1 for row in cut])
        first = self._first_numbers([row[0] for row in cut])
        return [np.concatenate([first[k : k + 1], rest]) for k, rest in enumerate(np.split(out, ends[:-1]))]

    def _pieces(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the pieces of all texts, and where each text starts, and the end."""
        if len(self.known) > CACHE_PIECES or self.used > CACHE_IDS or self.count > 2 * CACHE_PIECES:
            self.forget()
        if not self.safe:
            return self._learn(_strings(texts)), np.arange(len(texts) + 1)
        parts = pc.split_pattern(texts, " ")
        at = parts.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        flat = parts.flatten()
        starts = _strings(flat.take(pa.array(at[:-1])))
        distinct = flat.dictionary_encode()
        del parts, flat
        numbers = self._numbers(distinct.dictionary)[distinct.indices.to_numpy()]
        del distinct
        pa.default_memory_pool().release_unused()
        several = np.diff(at) > 1
        careful = np.array([len(s) > CACHE_CHARS or (not s or s[-1].isspace()) and more for s, more in zip(starts, several.tolist(), strict=True)], dtype=bool)
        numbers[at[:-1]] = 1  # any but 0
        odd = np.concatenate([[0], np.cumsum(numbers == 0)])
        careful |= odd[at[1:]] > odd[at[:-1]]
        plain = np.nonzero(~careful)[0]
        numbers[at[:-1][plain]] = self._first_numbers([starts[k] for k in plain.tolist()])
        if not careful.any():
            return numbers, at
        runs, sizes, before = [], np.diff(at), 0
        rows = np.nonzero(careful)[0]
        for k, again in zip(rows.tolist(), self._careful_numbers(_strings(texts.take(pa.array(rows)))), strict=True):
            runs += [numbers[before : at[k]], again]
            sizes[k], before = len(again), at[k + 1]
        runs.append(numbers[before:])
        return np.concatenate(runs), np.concatenate([[0], np.cumsum(sizes)])

    def counts(self, texts: pa.StringArray) -> np.ndarray:
        """The number of ids of each text."""
        numbers, at = self._pieces(texts)
        total = np.concatenate([[0], np.cumsum(self.n[numbers], dtype=np.int64)])
        return total[at[1:]] - total[at[:-1]]

    def ids(self, texts: pa.StringArray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, each followed by ``end``, and where each starts, and the end."""
        numbers, at = self._pieces(texts)
        self.pool[0] = end  # of number 1
        rows = len(texts)
        whole = np.ones(len(numbers) + rows, dtype=np.int32)
        whole[np.arange(len(numbers)) + np.repeat(np.arange(rows), np.diff(at))] = numbers
        n = self.n[whole]
        total = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        where = np.repeat(self.start[whole] - total[:-1], n)
        where += np.arange(total[-1])
        ids = self.pool[where]
        return ids, total[at + np.arange(rows + 1)]


def _strings(array: pa.StringArray) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


def _grown(array: np.ndarray, used: int, more: int) -> np.ndarray:
    if used + more <= len(array):
        return array
    out = np.zeros(used + more + used // 4, array.dtype)
    out[:used] = array[:used]
    return out


_ENCODERS: dict[tuple[str, bool], Encoder] = {}
#: Held while an encoder is used or forgets.
_USE = threading.Lock()


@contextmanager
def encoder(path: str, keep_ids: bool) -> Iterator[Encoder]:
    """One encoder a worker process for each tokenizer file.

    Workers outlive a stage, so what the encoder remembers goes when no batch
    came for ``IDLE`` seconds: the next stage gets the memory.
    """
    with _USE:
        key = path, keep_ids
        if key not in _ENCODERS:
            _ENCODERS[key] = Encoder(path, keep_ids)
        made = _ENCODERS[key]
        made.uses += 1
        yield made
        timer = threading.Timer(IDLE, _rest, (made, made.uses))
        timer.daemon = True
        if made.timer:
            made.timer.cancel()
        made.timer = timer
        timer.start()


def _rest(made: Encoder, uses: int) -> None:
    with _USE:
        if made.uses == uses:
            made.forget()
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)
