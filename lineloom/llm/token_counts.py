"""Token counts of a byte-level BPE vocabulary, with a whole-token shortcut.

Offline, every vocabulary string is encoded alone: those that come out as their
own single token form the shortcut set.  Texts are cut into pre-tokens; one in
the set counts 1 without merging, only the rest go through the library, each
distinct one once per worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: The byte-level pre-tokenisation pattern of the vocabulary. Fixed value.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Whitespace of the pattern's engine (Unicode White_Space), as ranges. Fixed value.
SPACE_CLASS = r"[\t-\r \x85\xa0  -     　]"
CACHE_ENTRIES = 400_000
LONG = 4096


def _bytes_to_chars() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable, else the next code point from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class Counter(dict):
    """Pre-token -> number of tokens; misses are merged and remembered up to a bound."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tok = Tokenizer.from_file(path)
        self.specials = sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.shortcut = whole_tokens(self.tok, self.specials)
        self.update(dict.fromkeys(self.shortcut, 1))
        self.base = len(self)
        self.merge = self._merger()

    def _merger(self):
        """Bytes of one pre-token -> ids, from the vocabulary's own ranks (merged strings have rising ids)."""
        import tiktoken

        back = {c: b for b, c in _bytes_to_chars().items()}
        ranks = {bytes(back[c] for c in p): i for p, i in self.tok.get_vocab(with_added_tokens=False).items() if all(c in back for c in p)}
        return tiktoken.Encoding("pieces", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def __missing__(self, word: str) -> int:
        n = len(self.merge(word.encode("utf-8")))
        if len(word) <= LONG:
            if len(self) >= self.base + CACHE_ENTRIES:
                self.clear()
                self.update(dict.fromkeys(self.shortcut, 1))
            self[word] = n
        return n


def whole_tokens(tok, specials: list[str]) -> set[str]:
    """Vocabulary strings proved to encode alone as one token (their own)."""
    back = {c: b for b, c in _bytes_to_chars().items()}
    vocab = tok.get_vocab(with_added_tokens=False)
    texts, ids = [], []
    for piece, i in vocab.items():
        try:
            text = bytes(back[c] for c in piece).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if text not in specials:
            texts.append(text)
            ids.append(i)
    return {t for t, i, e in zip(texts, ids, tok.encode_batch(texts, add_special_tokens=False), strict=True) if e.ids == [i]}


@lru_cache(maxsize=2)
def _tools(path: str):
    import regex

    counter = Counter(path)
    pattern = regex.compile(PRETOKEN.replace(r"\s+(?!\S)", f"{SPACE_CLASS}+(?!{_not(SPACE_CLASS)})").replace(r"[^\s", "[^" + SPACE_CLASS[1:-1]).replace(r"|\s+", f"|{SPACE_CLASS}+"))
    special = regex.compile("|".join(map(regex.escape, counter.specials))) if counter.specials else None
    return counter, pattern, special


def _not(cls: str) -> str:
    return "[^" + cls[1:]


def count_tokens(text: str, path: str) -> int:
    """Tokens of one text.  Special strings inside it are one token each, as the library treats them by default."""
    counter, pattern, special = _tools(path)
    n, at = 0, 0
    if special is not None and any(s in text for s in counter.specials):
        for m in special.finditer(text):
            n += 1 + sum(map(counter.__getitem__, pattern.findall(text[at : m.start()])))
            at = m.end()
        text = text[at:]
    # long texts are read in slices that end where a pre-token ends, so no list of all of them is held
    if len(text) <= 1 << 16:
        return n + sum(map(counter.__getitem__, pattern.findall(text)))
    return n + sum(counter[m.group()] for m in pattern.finditer(text))


def token_counts(docs: DataFrame, tokenizer_path: str, *, text_col: str = "text", limit: int = 1024, keep_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) for every row.

    Counts equal ``encode(text, add_special_tokens=False)`` without truncation or
    padding.  Null and empty texts have 0 of both.  Row-local: no shuffle; ties,
    repeated rows, other columns and empty tables need no care.  The worker's
    cache is bounded by ``CACHE_ENTRIES`` short strings.
    """
    src = docs.select(*keep_cols, docs[text_col].alias("_text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema.fields[:-1]) + "n_bytes bigint, n_tokens bigint, over_limit boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = b.columns[:-1]
            n_bytes, n_tokens = [], []
            for value in b.column(b.num_columns - 1):
                text = value.as_py() or ""
                n_bytes.append(len(text.encode("utf-8")))
                n_tokens.append(count_tokens(text, tokenizer_path) if text else 0)
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([x > limit for x in n_tokens], pa.bool_())],
                names=[*keep_cols, "n_bytes", "n_tokens", "over_limit"],
            )

    return src.mapInArrow(run, schema)
