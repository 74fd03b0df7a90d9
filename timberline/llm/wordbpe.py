"""Word-level BPE encoding by speculation and verification, and decoding.

For every word not seen before, greedy longest matches propose tokens. A sequence of tokens is what merging gives exactly
when every token and every two neighbours are what merging gives for them alone, so all proposals of a batch are checked
at once by looking their pairs up in a sorted table of judged pairs; a pair not judged yet is merged once and
remembered. Only the words with a failing pair are merged exactly.

Defined results: a null or empty text has no tokens and decodes to the empty text. Extra columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stands for the end-of-word mark inside this module; it never occurs in the byte alphabet.
END = "\x00"
_CONTROLS = re.compile("[\x1c-\x1f]")


def byte_alphabet() -> dict[int, str]:
    """Byte -> character of the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        inner = lambda s: s[: -len(suffix)] + END if s.endswith(suffix) and s != suffix else s
        self.ids = {inner(s): i for s, i in model["vocab"].items()}
        self.strings = {i: s for s, i in model["vocab"].items()}
        # Every start of a token: the token's id, or -1 for a mere start.
        self.starts = {s[:k]: -1 for s in self.ids for k in range(1, len(s))} | self.ids
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.specials.items()}
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = byte_alphabet()
        self.base = max(self.strings) + 2
        # Pair code -> (rank, merged token).
        self.ranks = {
            self.ids[inner(a)] * self.base + self.ids[inner(b)]: (r, self.ids[inner(a) + inner(b)])
            for r, (a, b) in enumerate(map(tuple, model["merges"]))
        }
        self.judged = np.empty(0, np.int64)  # sorted codes of pairs
        self.verdict = np.empty(0, bool)
        self.encoded: dict[str, list[int]] = {}  # word -> ids
        # For chunks: ids as decimal text, and token strings, joined by spaces.
        self.numbers: dict[str, str] = {}
        self.tokens: dict[str, str] = {}

    # -- exact merging -------------------------------------------------------------------------------------------
    def merged(self, word: str) -> list[int]:
        """Tokens of a word in the byte alphabet (END at its end, if it is a whole word) by merging in rank order."""
        ids, base, known, none = self.ids, self.base, self.ranks, (1 << 60, 0)
        if word[-1] == END:
            parts = [ids[c] for c in word[:-2]] + [ids[word[-2:]]]
        else:
            parts = [ids[c] for c in word]
        pairs = [known.get(a * base + b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = min(pairs)
            if best is none:
                break
            at = pairs.index(best)
            parts[at : at + 2] = [best[1]]
            del pairs[at]
            if at:
                pairs[at - 1] = known.get(parts[at - 1] * base + parts[at], none)
            if at < len(pairs):
                pairs[at] = known.get(parts[at] * base + parts[at + 1], none)
        return parts

    # -- speculation ---------------------------------------------------------------------------------------------
    def greedy(self, word: str) -> list[int]:
        starts, out, at, n = self.starts, [], 0, len(word)
        while at < n:
            end, best = at + 1, None
            while end <= n:
                found = starts.get(word[at:end], -2)
                if found == -2:
                    break
                if found >= 0 and end != n - 1:  # a token that ends there would leave the end mark alone
                    best, stop = found, end
                end += 1
            if best is None:
                raise ValueError(f"no token fits {word[at:]!r}")
            out.append(best)
            at = stop
        return out

    # -- verification --------------------------------------------------------------------------------------------
    def _inner(self, token: int) -> str:
        s = self.strings[token]
        return s[:-4] + END if s.endswith("</w>") and s != "</w>" else s

    def _judge(self, code: int) -> bool:
        a, b = divmod(code, self.base)
        tokens = [a, b - 1] if b else [a]
        return self.merged("".join(map(self._inner, tokens))) == tokens

    def compatible(self, codes: np.ndarray) -> np.ndarray:
        """For each pair code, whether merging the two tokens' text gives just these tokens."""
        new = np.setdiff1d(codes, self.judged)
        if len(new):
            if len(self.judged) > 2_000_000:
                self.judged, self.verdict, new = np.empty(0, np.int64), np.empty(0, bool), np.unique(codes)
            judged = np.concatenate([self.judged, new])
            verdict = np.concatenate([self.verdict, np.fromiter(map(self._judge, new.tolist()), bool, len(new))])
            order = np.argsort(judged)
            self.judged, self.verdict = judged[order], verdict[order]
        return self.verdict[np.searchsorted(self.judged, codes)]

    def encode_words(self, words: list[str]) -> None:
        """Adds distinct words (byte alphabet, END at the end) to ``encoded``."""
        if not words:
            return
        proposals = [self.greedy(w) for w in words]
        sizes = np.fromiter(map(len, proposals), np.int64, len(words))
        flat = np.fromiter((t for p in proposals for t in p), np.int64, int(sizes.sum()))
        # Every token pairs with its successor in the word; a word's only token with none (0).
        follows = np.zeros(len(flat), np.int64)
        follows[:-1] = flat[1:] + 1
        last = np.cumsum(sizes) - 1
        follows[last] = 0
        asked = np.ones(len(flat), bool)
        asked[last[sizes > 1]] = False
        good = np.ones(len(flat), bool)
        good[asked] = self.compatible((flat * self.base + follows)[asked])
        fine = np.logical_and.reduceat(good, last - sizes + 1)
        for word, tokens, ok in zip(words, proposals, fine):
            self.encoded[word] = tokens if ok else self.merged(word)

    # -- texts ---------------------------------------------------------------------------------------------------
    def chunks(self, text: str) -> list[str]:
        """Parts between white space and special tokens; nothing joins across these."""
        if _CONTROLS.search(text):  # str.split() would cut here, too
            parts = regex.split(r"\s+", _CONTROLS.sub(lambda m: chr(0xE000 + ord(m[0])), text))
            return ["".join(chr(ord(c) - 0xE000) if 0xE01C <= ord(c) <= 0xE01F else c for c in p) for p in parts if p]
        return text.split()

    def words(self, chunk: str) -> list[str]:
        if chunk.isascii() and chunk.isprintable():  # such characters stand for themselves
            chunk = chunk.lower()
            return [chunk + END] if chunk.isalpha() else [w + END for w in self.split.findall(chunk)]
        chunk = unicodedata.normalize("NFC", chunk)
        chunk = "".join(c.lower() for c in chunk) if "Σ" in chunk else chunk.lower()
        letters = self.letters
        return ["".join(map(letters.__getitem__, w.encode())) + END for w in self.split.findall(chunk)]

    def learn(self, chunks: set[str]) -> None:
        if len(self.numbers) > 400_000:
            self.numbers, self.tokens = {}, {}
        new = [c for c in chunks if c not in self.numbers]
        parts = [self.words(c) for c in new]
        self.encode_words(list({w for p in parts for w in p if w not in self.encoded}))
        strings, encoded = self.strings, self.encoded
        for chunk, words in zip(new, parts):
            ids = encoded[words[0]] if len(words) == 1 else [i for w in words for i in encoded[w]]
            self.numbers[chunk] = " ".join(map(str, ids))
            self.tokens[chunk] = " ".join(map(strings.__getitem__, ids))
        if len(encoded) > 400_000:
            self.encoded = {}

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """For each text: number of ids, the ids as decimal text, and what decoding gives."""
        split = []
        for text in texts:
            text = text or ""
            if "<|" in text and self.special_pattern.search(text):
                parts, at = [], 0
                for m in self.special_pattern.finditer(text):
                    # A special token's own chunk is marked by a space, which no other chunk holds.
                    parts += [*self.chunks(text[at : m.start()]), " " + m[0]]
                    at = m.end()
                split.append(parts + self.chunks(text[at:]))
            else:
                split.append(self.chunks(text))
        self.learn({c for parts in split for c in parts if c[0] != " "})
        for content, i in self.specials.items():
            self.numbers[" " + content], self.tokens[" " + content] = str(i), content
        number, token, out = self.numbers.__getitem__, self.tokens.__getitem__, []
        for parts in split:
            ids = " ".join(map(number, parts))
            out.append((ids.count(" ") + 1 if ids else 0, ids, " ".join(map(token, parts))))
        return out


@lru_cache
def _bpe(path: str) -> WordBPE:
    gc.set_threshold(200_000, 50, 100)  # the tables hold many small objects that never form cycles
    return WordBPE(path)


def encode(text: str | None, path: str) -> list[int]:
    ids = _bpe(path).digests([text])[0][1]
    return [int(x) for x in ids.split()]


def decode(ids: list[int], path: str) -> str:
    return " ".join(map(_bpe(path).strings.__getitem__, ids))


def encode_decode(docs: DataFrame, path: str, with_output: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids and decoded, if asked for)."""

    def run(batches):
        bpe = _bpe(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = bpe.digests(batch.column("text").to_pylist())
                columns = [
                    batch.column("doc_id"),
                    pa.array([x[0] for x in found], pa.int64()),
                    pa.array([sha(x[1]) for x in found]),
                    pa.array([sha(x[2]) for x in found]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_output:
                    columns += [pa.array([[int(i) for i in x[1].split()] for x in found], pa.list_(pa.int32())), pa.array([x[2] for x in found])]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, schema + (", ids array<int>, decoded string" if with_output else ""))
