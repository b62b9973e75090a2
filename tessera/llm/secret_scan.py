"""Secret scans: fixed patterns, and a linear-chain conditional random field.

The field tags white-space tokens as secret begin, inside or outside. Features
are a token's shape, its neighbours' shapes and the file's density of code-like
characters. It is trained by gradient ascent on the exact log-likelihood of
generated sequences. Decoding is Viterbi; a token whose outside score leads by
more than any transitions can make up is outside in every best path, so that
the chain is decoded between such tokens only, with the same result.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import map_texts, pick

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(rb"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")
#: Parts that every match of the patterns contains, for a fast first look.
KEYWORDS = (b"passw", b"secret", b"token", b"api")
RUN = b"0" * 16
HEX_RUNS = bytes(48 if c in b"0123456789abcdef" else 32 for c in range(256))
MIN_VALUE, MIN_ACCESS = 12, 18
#: Least bytes of what a pattern's span leaves of a span of the field.
MIN_REST = 8

OUT, BEGIN, INSIDE = 0, 1, 2
TAGS = 3
MEMO_WORDS = 300_000


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """``(start, end, kind)`` in bytes, leftmost non-overlapping per kind."""
    out = []
    low = text.lower()
    if any(w in low for w in KEYWORDS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= MIN_VALUE]
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if RUN in text.translate(HEX_RUNS):
        out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return out


# --- features ---------------------------------------------------------------

_CORE = re.compile(rb"[A-Za-z0-9+/_=.-]+")
_KEYWORD = re.compile(rb"(?i)^[\"'(]*(?:password|passwd|pwd|secret|token|api_?key|auth|bearer|credential|private_?key|access_?key)[\"']?[:=]*$")
_ADDRESS = re.compile(rb"(?:@|://|^\W*\d{1,3}(?:\.\d{1,3}){3}\W*$|^\W*www\.)")
FEATURES = ("bias", "long", "very_long", "mixed", "digits_only", "letters_only", "digit_share", "flips", "upper_run", "marker", "keyword", "assign", "address", "beyond", "short")


_PLAIN = re.compile(rb"[A-Za-z\x80-\xff]+[,.]?")
_MARKER = re.compile(rb"(?:gh[pousr]_|sk[-_]|xox[abp]-|eyJ|AIza|AKIA|glpat-)")


@lru_cache(maxsize=64)
def _letters(long: bool, very_long: bool, upper_run: bool, beyond: bool, short: bool) -> tuple[float, ...]:
    return (1.0, float(long), float(very_long), 0.0, 0.0, 1.0, 0.0, 0.0, float(upper_run), 0.0, 0.0, 0.0, 0.0, float(beyond), float(short))


def features(word: bytes) -> tuple[float, ...]:
    """Shape of one token; equal for most plain words, so memos stay small."""
    if _PLAIN.fullmatch(word) and not _MARKER.match(word) and not _KEYWORD.match(word):
        beyond = not word.isascii()
        core = max(_CORE.findall(word), key=len, default=b"") if beyond else word
        n = len(core.rstrip(b",."))
        return _letters(n >= 16, n >= 28, n >= 16 and core.isupper(), beyond, n < 8)
    core = max(_CORE.findall(word) or [b""], key=len)
    n = len(core)
    digits = sum(c in b"0123456789" for c in core)
    lower, upper = any(97 <= c <= 122 for c in core), any(65 <= c <= 90 for c in core)
    kinds = [0 if 48 <= c <= 57 else 1 if 97 <= c <= 122 else 2 if 65 <= c <= 90 else 3 for c in core]
    flips = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1)
    mixed = digits > 0 and (lower or upper)
    marker = bool(_MARKER.match(core)) and n >= 12
    return (
        1.0, float(n >= 16), float(n >= 28), float(mixed and n >= 12), float(digits == n and n > 0), float(digits == 0),
        round(4 * digits / max(1, n)) / 4 if n >= 12 else 0.0, round(4 * flips) / 4 if n >= 12 and mixed else 0.0, float(upper and not lower and n >= 16), float(marker),
        float(bool(_KEYWORD.match(word))), float(b"=" in word[:-1] or word.endswith(b"=")), float(bool(_ADDRESS.search(word))), float(any(c > 127 for c in word)), float(n < 8),
    )


def file_feature(text: bytes) -> float:
    """Density of code-like characters, 0 to 1."""
    marks = sum(text.count(c) for c in (b"=", b"{", b"}", b";", b"_", b":"))
    return min(1.0, 40.0 * marks / max(200, len(text)))


class Crf:
    """Weights: own, previous and next token's features by tag, the file's
    feature by tag, and transitions (from ``OUT`` at both ends)."""

    def __init__(self) -> None:
        f = len(FEATURES)
        self.own, self.prev, self.next = (np.zeros((f, TAGS)) for _ in range(3))
        self.file = np.zeros(TAGS)
        self.trans = np.zeros((TAGS, TAGS))
        self.trans[OUT, INSIDE] = -50.0

    @property
    def slack(self) -> float:
        """The most that a token's change to outside, and with it that of a
        following inside to begin, can lose on three transitions."""
        return 3 * (self.trans.max() - self.trans[self.trans > -40].min())

    def emissions(self, feats: np.ndarray, file: float) -> np.ndarray:
        e = feats @ self.own + file * self.file
        e[1:] += feats[:-1] @ self.prev
        e[:-1] += feats[1:] @ self.next
        return e

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """Best tags of one chain between two outside tokens."""
        n = len(e)
        score, back = self.trans[OUT] + e[0], np.zeros((n, TAGS), dtype=np.int64)
        for t in range(1, n):
            m = score[:, None] + self.trans
            back[t] = m.argmax(axis=0)
            score = m.max(axis=0) + e[t]
        tags = np.zeros(n, dtype=np.int64)
        tags[-1] = int((score + self.trans[:, OUT]).argmax())
        for t in range(n - 1, 0, -1):
            tags[t - 1] = back[t, tags[t]]
        return tags

    def decode(self, e: np.ndarray) -> np.ndarray:
        """Best tags of a whole text."""
        tags = np.zeros(len(e), dtype=np.int64)
        after = np.append(np.maximum(0, e[1:, INSIDE] - e[1:, BEGIN]), 0)
        open_ = np.flatnonzero(e[:, 1:].max(axis=1) + self.slack + after >= e[:, OUT])
        if len(open_):
            cuts = np.flatnonzero(np.diff(open_) > 1) + 1
            for part in np.split(open_, cuts):
                tags[part] = self.viterbi(e[part])
        return tags

    def fit(self, sentences: list[tuple[np.ndarray, np.ndarray, float]], steps: int = 150, rate: float = 0.3, decay: float = 1e-3) -> Crf:
        """Gradient ascent on the mean log-likelihood; equal-length chains."""
        x = np.stack([s[0] for s in sentences])
        y = np.stack([s[1] for s in sentences])
        file = np.array([s[2] for s in sentences])
        b, n, _ = x.shape
        gold = np.eye(TAGS)[y]
        gold_t = np.einsum("bti,btj->ij", gold[:, :-1], gold[:, 1:]) + np.outer(np.eye(TAGS)[OUT], gold[:, 0].sum(0)) + np.outer(gold[:, -1].sum(0), np.eye(TAGS)[OUT])
        free = np.ones((TAGS, TAGS))
        free[OUT, INSIDE] = 0
        speed = [np.zeros_like(w) for w in (self.own, self.prev, self.next, self.file, self.trans)]

        def lse(a: np.ndarray, axis: int) -> np.ndarray:
            m = a.max(axis=axis, keepdims=True)
            return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)

        for _ in range(steps):
            e = x @ self.own + (file[:, None] * self.file)[:, None, :]
            e[:, 1:] += x[:, :-1] @ self.prev
            e[:, :-1] += x[:, 1:] @ self.next
            fwd, bwd = np.zeros((b, n, TAGS)), np.zeros((b, n, TAGS))
            fwd[:, 0] = self.trans[OUT] + e[:, 0]
            for t in range(1, n):
                fwd[:, t] = lse(fwd[:, t - 1, :, None] + self.trans, 1) + e[:, t]
            bwd[:, -1] = self.trans[:, OUT]
            for t in range(n - 2, -1, -1):
                bwd[:, t] = lse(self.trans + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
            z = lse(fwd[:, -1] + self.trans[:, OUT], 1)
            p = np.exp(fwd + bwd - z[:, None, None])
            pair = np.exp(fwd[:, :-1, :, None] + self.trans + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None])
            d = gold - p
            want_t = pair.sum(axis=(0, 1)) + np.outer(np.eye(TAGS)[OUT], p[:, 0].sum(0)) + np.outer(p[:, -1].sum(0), np.eye(TAGS)[OUT])
            grads = (np.einsum("btf,btk->fk", x, d), np.einsum("btf,btk->fk", x[:, :-1], d[:, 1:]), np.einsum("btf,btk->fk", x[:, 1:], d[:, :-1]), np.einsum("b,btk->k", file, d), (gold_t - want_t) * free)
            for w, g, v in zip((self.own, self.prev, self.next, self.file, self.trans), grads, speed, strict=True):
                v *= 0.9
                v += rate * (g / b - decay * w * (np.abs(w) < 40))
                w += v
        return self


def training_sentences(count: int = 500, length: int = 24, seed: int = 5) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Generated chains: prose with numbers, addresses and long words, some
    with secrets of common forms, some after a keyword."""
    import random

    r = random.Random(seed)
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    join = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))

    def plain() -> str:
        k = r.random()
        if k < 0.80:
            w = join(letters, r.randint(1, 14))
            return r.choice((w, w, w, w.capitalize(), w.upper() + "!!", w + ",", w + ".", w + "é"))
        if k < 0.84:
            return join(letters, r.randint(16, 45))
        if k < 0.89:
            return r.choice((join(digits, r.randint(1, 19)), f"+1 ({join(digits, 3)})", f"{join(digits, 3)}-{join(digits, 4)}", f"{join(digits, 4)}-{join(digits, 2)}-{join(digits, 2)}"))
        if k < 0.93:
            return r.choice((f"{join(letters, 6)}.{join(digits, 2)}@{join(letters, 5)}{join(digits, 1)}.example.com", f"https://{join(letters, 8)}.example.org/{join(letters, 4)}/{join(digits, 5)}?page={join(digits, 1)}", ".".join(join(digits, 2) for _ in range(4))))
        if k < 0.96:
            return r.choice(("|", "=", "***", "&&&", join(letters, 5) + "$$$", join(letters, 7) + "%%%", "v1.2.3", "x=1", join(letters, 4) + "-" + join(letters, 6) + "-" + join(letters, 5), join(letters, 3) + "_" + join(letters, 9) + join(digits, 1)))
        return r.choice(("password", "token", "secret", "the", "key:"))

    def secret() -> list[str]:
        both, hexa = letters + letters.upper() + digits, digits + "abcdef"
        value = r.choice((lambda: join(hexa, r.choice((32, 40, 64))), lambda: join(both, r.randint(20, 44)), lambda: "ghp_" + join(both, 36), lambda: "sk-" + join(both, 32), lambda: "eyJ" + join(both, 20) + "." + join(both, 24), lambda: "AIza" + join(both, 35), lambda: "AKIA" + join(letters.upper() + digits, 16)))()
        wrap = r.choice(("{}", "{}", "'{}'", '"{}"', "{},", "{}."))
        if r.random() < 0.15:
            cut = len(value) // 2
            return [value[:cut], value[cut:]] if cut >= 16 else [wrap.format(value)]
        return [wrap.format(value)]

    out = []
    for i in range(count):
        words: list[str] = []
        tags: list[int] = []
        while len(words) < length:
            if i % 2 and r.random() < 0.06:
                if r.random() < 0.5:
                    words += r.choice((["password", "="], ["token:"], ["api_key", "="], ["secret", ":"], ["Bearer"]))
                    tags += [OUT] * (len(words) - len(tags))
                value = secret()
                words += value
                tags += [BEGIN] + [INSIDE] * (len(value) - 1)
            else:
                words += plain().split()
                tags += [OUT] * (len(words) - len(tags))
        words, tags = words[:length], tags[:length]
        text = " ".join(words).encode()
        out.append((np.array([features(w.encode()) for w in words]), np.array(tags), file_feature(text)))
    return out


@lru_cache(maxsize=1)
def trained() -> Crf:
    return Crf().fit(training_sentences())


class Tagger:
    """Finds the field's spans; memoises tokens by shape in bounded memory."""

    def __init__(self, model: Crf):
        self.model = model
        self.rows: dict[tuple[float, ...], int] = {}
        self.memo: dict[bytes, int] = {}
        self.scores = np.zeros((0, 3 * TAGS))
        self.fresh: list[tuple[float, ...]] = []

    def _row(self, word: bytes) -> int:
        f = features(word)
        if f not in self.rows:
            self.rows[f] = len(self.rows)
            self.fresh.append(f)
        if len(self.memo) >= MEMO_WORDS:
            self.memo.clear()
        if len(word) <= 64:
            self.memo[word] = self.rows[f]
        return self.rows[f]

    def spans(self, text: bytes) -> list[tuple[int, int]]:
        words = text.split()
        if not words:
            return []
        try:
            ids = np.fromiter(map(self.memo.__getitem__, words), dtype=np.int64, count=len(words))
        except KeyError:
            ids = np.array([self.memo[w] if w in self.memo else self._row(w) for w in words])
        if self.fresh:
            x, m = np.array(self.fresh), self.model
            self.scores = np.concatenate([self.scores, np.concatenate([x @ m.own, x @ m.prev, x @ m.next], axis=1)])
            self.fresh = []
        s = self.scores[ids]
        e = s[:, :TAGS] + file_feature(text) * self.model.file
        e[1:] += s[:-1, TAGS : 2 * TAGS]
        e[:-1] += s[1:, 2 * TAGS :]
        tags = self.model.decode(e)
        if not tags.any():
            return []
        places = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
        out: list[list[int]] = []
        for t in np.flatnonzero(tags).tolist():
            if tags[t] == INSIDE and out and out[-1][2] == t - 1:
                out[-1][1:] = [places[t][1], t]
            else:
                out.append([places[t][0], places[t][1], t])
        return [self.trim(text, a, b) for a, b, _ in out]

    @staticmethod
    def trim(text: bytes, a: int, b: int) -> tuple[int, int]:
        """Without white space, quotes and punctuation around the value."""
        core = text[a:b]
        left = len(core) - len(core.lstrip(b" \t\n\v\f\r\"'([{<,;:"))
        right = len(core.rstrip(b" \t\n\v\f\r\"')]}>,;:.!?"))
        return (a + left, a + right) if right > left else (a, b)


def left_over(text: bytes, found: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What the patterns' spans leave of the field's, in one sweep over both.
    A span may reach over a pattern's span beside it; the rest of it stays, if
    it has ``MIN_REST`` bytes without the marks around it."""
    out, walls, i = [], sorted((a, b) for a, b, _ in base), 0
    for a, b in sorted(found):
        while i < len(walls) and walls[i][1] <= a:
            i += 1
        at, j, cut = a, i, False
        while j < len(walls) and walls[j][0] < b:
            if walls[j][0] > at:
                out.append((*Tagger.trim(text, at, walls[j][0]), True))
            at, cut = max(at, walls[j][1]), True
            j += 1
        if at < b:
            out.append((*Tagger.trim(text, at, b), cut))
    return [(a, b) for a, b, cut in out if b - a >= (MIN_REST if cut else 1)]


def find_spans(text: bytes, tagger: Tagger) -> list[tuple[int, int, int]]:
    """All spans in code points, by start and kind; the field's spans are cut
    where they meet those of the patterns."""
    base = base_spans(text)
    found = sorted(base + [(a, b, 3) for a, b in left_over(text, tagger.spans(text), base)], key=lambda s: (s[0], s[2]))
    if not text.isascii():
        starts = np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80) if found else None
        point = lambda i: int(starts[i - 1]) if i else 0
        found = [(point(a), point(b), k) for a, b, k in found]
    return found


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """Per row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans,
    redacted`` (the text with every span replaced by ``[SECRET]``).

    Null texts are scanned as empty ones and stay null in ``redacted``. Rows
    are independent; extra columns are ignored; no rows give no rows. A very
    long text is scanned whole, in time that follows its length and its number
    of spans. Of paths of equal score the decoder takes outside before begin
    before inside.
    """
    tagger = Tagger(model or trained())

    def rows(part: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        out = []
        for t in texts:
            found = find_spans(t or b"", tagger)
            base = [s for s in found if s[2] < 3]
            counts = [sum(s[2] == k for s in base) for k in range(3)]
            out.append((*counts, hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(found), redact(t, found)))
        cols = list(zip(*out, strict=True))
        types = [pa.int64()] * 3 + [pa.string()] * 3
        return pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"])

    return map_texts(pick(docs, "doc_id", "text"), rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string")


def redact_documents(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """``docs`` with every span replaced in ``text``, and ``n_chars``, where
    there is one, counted anew for changed texts; nothing else changes."""
    tagger = Tagger(model or trained())
    sized = "n_chars" in docs.columns

    def rows(part: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        found = [find_spans(t or b"", tagger) for t in texts]
        if any(found):
            at = part.schema.get_field_index("text")
            new = [redact(t, f) for t, f in zip(texts, found, strict=True)]
            part = part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))
            if sized:
                at = part.schema.get_field_index("n_chars")
                old = part.column(at).to_pylist()
                part = part.set_column(at, part.schema.field(at), pa.array([len(t) if f else n for t, f, n in zip(new, found, old, strict=True)], part.schema.field(at).type))
        return part

    return map_texts(docs, rows, docs.schema)


def redact(text: bytes | None, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str | None:
    """Text with overlapping spans merged and replaced."""
    if text is None:
        return None
    s = text.decode()
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [s[at:a], mark]
        at = max(at, b)
    return "".join([*out, s[at:]]) if spans else s


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scanned."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("redacted")

