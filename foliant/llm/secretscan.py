"""Secret scan: base patterns and a linear-chain conditional random field.

A text is cut into tokens (runs of letters, digits and ``+ / _ -``). The field tags
each as begin (B) or inside (I) of a secret or outside (O), from

* shape: length, kinds of characters, changes between them, their share and that of
  capitals, the longest run of consonants (words have fewer than random letters), digits, hexadecimal, prefix,
* neighbours: the words on both sides by a hash, whether those before name a secret, the
  signs between (passwords go on behind some), the shapes beside,
* the file: how many tokens have digits, and whether any word names a secret.

It is trained by maximum likelihood (forward-backward over windows, in numpy) on at
most ``TRAIN_ROWS`` texts, chosen evenly by a hash of id and text: what the base patterns find in
them, and secrets of many forms made up and put among their words.

Decoding is exact Viterbi over the whole text. A token at which O beats each other
tag by more than all that the transitions on its two sides could give back is O on
the best path whatever its neighbours are; numpy finds these, nearly all, and the
recursion runs over the stretches between them.

Of equally good paths the one with O, or else B, at the last place where they differ
counts. What the field finds counts from LEAST bytes on. Null texts are empty. Spans are code points, end exclusive. Base spans always
stay; a span of the field that base spans touch is cut to what they leave of it.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import bounded_batches, room_for, sample, share_of
from .textbatch import arrow_batches, fold_ascii, runs, span_hash, text_bytes

# Base patterns, fixed values: (kind, pattern, group that is measured, its least length).
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
BASE = (("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32))
KINDS = {"assign": 0, "access": 1, "hex": 2, "crf": 3}

# Words that name a secret, and how many forms of keys begin.
NAMES = ("password", "passwd", "pwd", "passphrase", "secret", "token", "apikey", "api_key", "api-key", "key", "auth", "authorization", "bearer", "credential", "credentials", "private_key", "client_secret", "access_key", "secret_key", "access_token")
PREFIXES = ("AKIA", "ghp_", "gho_", "xoxb", "xoxp", "sk_l", "pk_l", "eyJh", "AIza", "SG_a", "glpa", "npm_")

TRAIN_ROWS = 600
#: Longer texts are not trained on; they are scanned like any other.
TRAIN_CHARS = 100_000
WINDOW = 16
O, B, I = 0, 1, 2

_KIND = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 4 digit, 8 sign, 16 other letters
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[*b"+/_-"]], _KIND[128:] = 1, 2, 4, 8, 16
_CONSONANT = np.zeros(256, bool)
_CONSONANT[[*b"bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ"]] = True
_HEX = np.zeros(256, bool)
_HEX[[*b"0123456789abcdef"]] = True
#: Signs that passwords hold, besides those of tokens.
GLUE = b"!$@#%^&*~"
_GLUE = np.zeros(256, bool)
_GLUE[[*GLUE]] = True
_LENGTH = np.zeros(4096, np.int64)
for _least in (4, 8, 12, 16, 20, 32, 36, 41, 64):
    _LENGTH[_least:] += 1
_SHARE = np.array([0, 1, 1, 2, 2, 3, 3, 3, 4, 4, 4])
_CHANGES = np.array([0, 1, 2, 3, 3, 4, 4, 4, 4] + [5] * 56)
#: Buckets of neighbouring words. Only words of a usual length are told apart.
WORDS = 256
#: How many values each feature has.
SIZES = (10 * 32, 6 * 2 * 10, 5 * 10, 2 * 16, 2 * 16, 16, len(PREFIXES) + 1, 32 * 2, 32 * 2, 4 * 2, WORDS + 1, WORDS + 1, 10 * 5 * 10, 10 * 10)
_FIRST = np.cumsum((0, *SIZES))[:-1]


def _word_hashes(words: tuple[str, ...]) -> np.ndarray:
    buf, offsets = text_bytes(pa.array(words, pa.string()))
    return np.sort(span_hash(buf, offsets[:-1], offsets[1:]))


_NAMES = _word_hashes(NAMES)
_PREFIX = {int.from_bytes(p.encode(), "little"): k for k, p in enumerate(PREFIXES, 1)}


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, tokens per text, and feature numbers (a row for each token)."""
    kind = _KIND[buf]
    starts, ends, count = runs(kind > 0, offsets)
    n = len(starts)
    if not n:
        return starts, ends, count, np.zeros((0, len(SIZES)), np.int64)
    total = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int32)])
    between = lambda t, a, b: t[b] - t[a]
    size = ends - starts
    length = _LENGTH[np.minimum(size, 4095)]
    classes, counts = np.zeros(n, np.int64), {}
    for bit in (1, 2, 4, 8, 16):
        counts[bit] = between(total(kind == bit), starts, ends)
        classes += bit * (counts[bit] > 0)
    digits = _SHARE[10 * counts[4] // size]
    changes = between(total(np.concatenate([[False], kind[1:] != kind[:-1]])), np.minimum(starts + 1, ends), ends)
    a, b, _ = runs(_CONSONANT[buf], offsets)
    harsh = np.zeros(n, np.int64)
    np.maximum.at(harsh, np.searchsorted(starts, a, side="right") - 1, b - a)
    upper = np.minimum(7 * counts[2] // size, 4)
    hexes = between(total(_HEX[buf]), starts, ends) == size
    begin = np.cumsum(count) - count
    is_first = np.zeros(n + 1, bool)
    is_first[begin] = True
    is_first[n] = True
    # the signs before each token: 1 an equals sign or colon, 2 a quote, 4 a line feed or the text's start, 8 only such as passwords hold
    left = np.concatenate([[0], ends[:-1]])
    doc_start = np.repeat(offsets[:-1], count)
    left = np.maximum(left, doc_start)
    gap = np.zeros(n + 1, np.int64)
    for bit, chars in ((1, b"=:"), (2, b"\"'`"), (4, b"\n")):
        flag = np.zeros(256, bool)
        flag[[*chars]] = True
        gap[:n] |= bit * (between(total(flag[buf]), left, starts) > 0)
    gap[:n] |= 8 * ((starts > left) & (between(total(_GLUE[buf]), left, starts) == starts - left))
    gap[is_first] = gap[is_first] & 7 | 4
    named, word = np.zeros(n, bool), np.zeros(n, np.int64)
    maybe = np.flatnonzero((size >= 2) & (size <= 16))
    if len(maybe):
        h = span_hash(fold_ascii(buf), starts[maybe], ends[maybe])
        named[maybe] = _NAMES[np.minimum(np.searchsorted(_NAMES, h), len(_NAMES) - 1)] == h
        word[maybe] = 1 + (h & np.uint64(WORDS - 1)).astype(np.int64)
    before = np.concatenate([[False], named[:-1]]) & ~is_first[:n]
    before2 = np.concatenate([[False], before[:-1]]) & ~is_first[:n]
    prefix = np.zeros(n, np.int64)
    long = np.flatnonzero(size >= 12)
    if len(long):
        four = sum(buf[starts[long] + k].astype(np.int64) << (8 * k) for k in range(4))
        for value, k in _PREFIX.items():
            prefix[long[four == value]] = k
    shape = classes * 2 + (size >= 16)
    prev = np.where(is_first[:n], 0, np.concatenate([[0], shape[:-1]]))
    following = np.where(is_first[1:], 0, np.concatenate([shape[1:], [0]]))
    word_before = np.where(is_first[:n], 0, np.concatenate([[0], word[:-1]]))
    word_behind = np.where(is_first[1:], 0, np.concatenate([word[1:], [0]]))
    share = between(total(counts[4] > 0), begin, begin + count) / np.maximum(count, 1)
    names = between(total(named), begin, begin + count) > 0
    file = np.repeat(np.digitize(share, (0.02, 0.1, 0.3)) * 2 + names, count)
    columns = (length * 32 + classes, (_CHANGES[np.minimum(changes, 63)] * 2 + hexes) * 10 + length, digits * 10 + length, before * 16 + gap[:n], before2 * 16 + gap[:n], gap[1:], prefix, following, prev, file, word_before, word_behind, (np.minimum(20 * changes // size, 9) * 5 + upper) * 10 + length, np.minimum(harsh, 9) * 10 + length)
    return starts, ends, count, np.stack(columns, axis=1) + _FIRST


@dataclass
class Field:
    """Weights of each feature value and of each step between tags."""

    weight: np.ndarray
    step: np.ndarray

    def emissions(self, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros((len(numbers), 3))
        for k in range(numbers.shape[1]):
            out += self.weight[numbers[:, k]]
        return out

    def safe(self, emission: np.ndarray) -> np.ndarray:
        """Tokens that are O on every best path."""
        ok = np.ones(len(emission), bool)
        for tag in (B, I):
            back = max(0, (self.step[:, tag] - self.step[:, O]).max()) + max(0, (self.step[tag] - self.step[O]).max())  # 0: beside a text's end
            ok &= emission[:, O] - emission[:, tag] > back
        return ok

    def viterbi(self, emission: np.ndarray, left: bool, right: bool) -> list[int]:
        """The best tags of a stretch; left, right: whether an O stands beside it."""
        step, rows = self.step.tolist(), emission.tolist()
        best = [e + (step[O][t] if left else 0.0) for t, e in enumerate(rows[0])]
        back = []
        for row in rows[1:]:
            choice = [max(range(3), key=lambda s, t=t: best[s] + step[s][t]) for t in range(3)]
            best = [best[choice[t]] + step[choice[t]][t] + row[t] for t in range(3)]
            back.append(choice)
        if right:
            best = [b + step[t][O] for t, b in enumerate(best)]
        tags = [max(range(3), key=best.__getitem__)]
        for choice in reversed(back):
            tags.append(choice[tags[-1]])
        return tags[::-1]

    def tags(self, numbers: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Tags of all tokens of a batch; each text is a chain of its own."""
        emission = self.emissions(numbers)
        safe = self.safe(emission)
        out = np.zeros(len(numbers), np.int64)
        at = np.concatenate([[0], np.cumsum(count)])
        starts, ends, _ = runs(~safe, at)
        for i, j in zip(starts.tolist(), ends.tolist(), strict=True):
            k = int(np.searchsorted(at, i, side="right")) - 1
            out[i:j] = self.viterbi(emission[i:j], i > at[k], j < at[k + 1])
        return out


def train(numbers: np.ndarray, tags: np.ndarray, epochs: int = 14, batch: int = 512, decay: float = 1e-4, seed: int = 5) -> Field:
    """numbers (windows, tokens, features) and tags (windows, tokens): maximum likelihood by Adam steps over small batches."""
    n, length, width = numbers.shape
    size = int(sum(SIZES))
    weight, step = np.zeros((size, 3)), np.zeros((3, 3))
    if not n:
        weight[:, O] = 1.0
        return Field(weight, step)
    moments = [np.zeros_like(x) for x in (weight, weight, step, step)]
    rng, k = np.random.default_rng(seed), 0
    steps = epochs * -(-n // batch)
    for _ in range(epochs):
        order = rng.permutation(n)
        for part in np.array_split(order, -(-n // batch)):
            k += 1
            up, up_step = _gradient(weight, step, numbers[part], np.eye(3)[tags[part]])
            rate = 0.15 * (1 - 0.95 * k / steps)
            for x, g, (m, v) in ((weight, up - decay * weight, moments[:2]), (step, up_step - decay * step, moments[2:])):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Field(weight, step)


def _gradient(weight: np.ndarray, step: np.ndarray, numbers: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the mean log likelihood of some windows, by the weights and by the steps: forward and backward sums."""
    n, length, width = numbers.shape
    e = weight[numbers].sum(axis=2)
    ahead, behind = np.zeros((n, length, 3)), np.zeros((n, length, 3))
    ahead[:, 0] = e[:, 0]
    soft = lambda x: np.logaddexp.reduce(x, axis=1)
    for t in range(1, length):
        ahead[:, t] = e[:, t] + soft(ahead[:, t - 1, :, None] + step)
    for t in range(length - 2, -1, -1):
        behind[:, t] = soft((step + (e[:, t + 1] + behind[:, t + 1])[:, None, :]).transpose(0, 2, 1))
    norm = np.logaddexp.reduce(ahead[:, -1], axis=1)[:, None, None]
    off = (gold - np.exp(ahead + behind - norm)).reshape(-1, 3)
    pairs = np.exp(ahead[:, :-1, :, None] + step + (e + behind)[:, 1:, None, :] - norm[..., None])
    up_step = np.einsum("ntab->ab", gold[:, :-1, :, None] * gold[:, 1:, None, :] - pairs) / n
    flat = numbers.reshape(-1)
    return np.stack([np.bincount(flat, np.repeat(off[:, c], width), len(weight)) for c in range(3)], axis=1) / n, up_step


def made_up(rng: random.Random) -> str:
    """A secret of some usual form, random."""
    pick = lambda chars, n: "".join(rng.choices(chars, k=n))
    lower, alnum, base64 = string.ascii_lowercase + string.digits, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    return rng.choice([
        lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16),
        lambda: "ghp_" + pick(alnum, 36),
        lambda: f"xoxb-{pick(string.digits, 11)}-{pick(string.digits, 12)}-{pick(alnum, 24)}",
        lambda: "sk_live_" + pick(alnum, 24),
        lambda: f"eyJhbGciOi{pick(alnum, 20)}.eyJ{pick(alnum, 40)}.{pick(alnum + '_-', 43)}",
        lambda: "AIza" + pick(alnum + "_-", 35),
        lambda: pick("0123456789abcdef", rng.choice([18, 24, 32, 40, 64])),
        lambda: pick(alnum, rng.randint(16, 48)),
        lambda: pick(base64, rng.choice([40, 44, 64])),
        lambda: pick(lower, rng.randint(16, 32)),
        lambda: pick(string.ascii_letters, rng.randint(24, 48)),
        lambda: pick(string.ascii_uppercase + string.digits, rng.randint(20, 48)),
        lambda: pick(string.ascii_letters, rng.randint(2, 6)) + rng.choice("_-") + pick(alnum, rng.randint(18, 44)),
        lambda: pick(alnum + GLUE.decode(), rng.randint(10, 24)),
        lambda: pick(string.ascii_letters, rng.randint(3, 7)) + pick(GLUE.decode(), 1) + pick(alnum, rng.randint(3, 8)) + pick(GLUE.decode(), rng.randint(0, 2)) + pick(string.digits, rng.randint(2, 4)),
    ])()


#: The first few give a secret a name.
CONTEXTS = ("{name}={s}", '{name} = "{s}"', "{name}: {s}", "{name}: '{s}'", "Bearer {s}", "{s}", "{s}", "{s}", "{s}", '"{s}"', "({s})", "{name} {s}", 'export {name}="{s}"')


def joined(words: list[str], rng: random.Random) -> str:
    """Words as one token: with signs between, or as programs name things, with capitals in place of signs."""
    sign = rng.choice(("-", "_", "/", "\u00a0", "", "", ""))
    if sign != "\u00a0" and rng.random() < (0.2 if sign else 1.0):
        most = rng.choice((4, 8, 20))
        words = ["".join(filter(str.isalnum, w))[: rng.randint(1, most)] for w in words]
    if not sign:
        words = [w[:4].upper() if rng.random() < 0.15 else w[:1].upper() + w[1:] for w in words]
        if rng.random() < 0.3:
            words[0] = words[0].lower()
        if rng.random() < 0.1:
            words.append(str(rng.randrange(100)))
    text = sign.join(words)
    return text.upper() if sign in ("-", "_") and rng.random() < 0.2 else text


#: Forms in which prose and programs have the signs of passwords.
SIGNED = ("{a}*{b}", "%{a}", "%d{a}", "{a}&{b}", "[^{a}-{b}]", "{a}%{b}", "${a}", "@{a}.{b}", "{a}@{b}.{c}", "#{a}-{b}", "{a}*{b}*{c}", "${a}/{b}", "~{a}/{b}/{c}", "{a}!", "{a}^{b}", "{a}&{b}={c}&{d}={a}", "%{a}%{b}")


def signed(words: list[str], rng: random.Random) -> str:
    """Words or numbers in one of the forms of SIGNED."""
    some = [rng.choice(words)[:12] if rng.random() < 0.7 else str(rng.randrange(10 ** rng.randint(1, 5))) for _ in range(4)]
    return rng.choice(SIGNED).format(a=some[0], b=some[1], c=some[2], d=some[3])


def planted(text: str, rng: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """The text with a few secrets made up among its words, and where they are; a few of its words, or of words joined to one token, stand as secrets would."""
    words = text.split(" ")
    out, spans, at = [], [], 0
    places = rng.sample(range(len(words)), min(len(words), rng.randint(1, 12)))
    secrets = set(places[: 2 * len(places) // 5 + 1])
    for k, word in enumerate(words):
        if k in places:
            made = made_up(rng) if k in secrets else signed(words, rng) if rng.random() < 0.2 else joined(words[k : k + rng.choice((1, 2, 3, 4, 5, 6, 8))], rng)
            name = rng.choice(NAMES).upper() if rng.random() < 0.3 else rng.choice(NAMES)
            some = CONTEXTS[:4] if k in secrets and _GLUE[[*made.encode()]].any() else CONTEXTS  # only a name tells such a secret from prose
            word = rng.choice(some).format(name=name, s=made)
            if k in secrets:
                i = at + word.index(made)
                spans.append((i, i + len(made)))
        out.append(word)
        at += len(word) + 1
    return " ".join(out), spans


def examples(texts: list[str], seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Windows around secrets, found or planted, and elsewhere."""
    rng = random.Random(seed)
    numbers, tags = [np.zeros((0, WINDOW, len(SIZES)), np.int64)], [np.zeros((0, WINDOW), np.int64)]
    for text in texts:
        for most, (body, spans) in ((3, (text, [])), (12, planted(text, rng))):
            spans = spans + [(m.start(2), m.end(2)) if kind == "assign" else (m.start(), m.end()) for kind, m in base_matches(body)]
            # offsets in bytes
            spans = sorted((len(body[:i].encode()), len(body[:j].encode())) for i, j in spans)
            starts, ends, _, rows = tokens(*text_bytes(pa.array([body])))
            if len(rows) < WINDOW:
                continue
            tag = np.zeros(len(rows), np.int64)
            for i, j in spans:
                inside = np.flatnonzero((starts >= i) & (ends <= j) & (tag == O))
                tag[inside[:1]], tag[inside[1:]] = B, I
            odd = np.flatnonzero((tag > 0) | (rows[:, 2] - _FIRST[2] >= 10) | (rows[:, 3] - _FIRST[3] > 0))  # secrets, other tokens with digits, what stands behind a sign
            centres = [*rng.sample(odd.tolist(), min(most, len(odd))), *rng.sample(range(len(rows)), 2)]
            first = np.clip(np.array(centres) - [rng.randrange(WINDOW) for _ in centres], 0, len(rows) - WINDOW)
            at = first[:, None] + np.arange(WINDOW)
            numbers.append(rows[at])
            tags.append(tag[at])
    return np.concatenate(numbers), np.concatenate(tags)


def base_matches(text: str) -> list[tuple[str, re.Match]]:
    return [(kind, m) for kind, pattern, group, least in BASE for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Field:
    """Train on at most ``rows`` texts; no more reach the driver, whatever ids repeat or are null."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    docs = docs.where(F.length("text") <= TRAIN_CHARS)
    chosen, at = sample(docs, share_of(docs, rows, "id", "text"), "id", "text")
    chosen = chosen.orderBy(at, "id", "text").limit(rows).collect()
    return train(*examples(sorted(r.text for r in chosen)))


#: Bytes of a field's span at least.
LEAST = 8
_ENDS = b"=" + GLUE
_HINTS = (b"passw", b"secret", b"token", b"api_key", b"apikey")


def scan(col: pa.Array, field: Field) -> list[list[tuple[str, int, int]]]:
    """Each text's spans by start and kind."""
    buf, offsets = text_bytes(col)
    starts, ends, count, rows = tokens(buf, offsets)
    tags = field.tags(rows, count)
    at = np.concatenate([[0], np.cumsum(count)])
    found: dict[int, list[tuple[int, int]]] = {}
    hit = np.flatnonzero(tags)
    for k, doc in zip(hit.tolist(), (np.searchsorted(at, hit, side="right") - 1).tolist(), strict=True):
        spans = found.setdefault(doc, [])
        i, j = int(starts[k] - offsets[doc]), int(ends[k] - offsets[doc])
        if tags[k] == I and k > at[doc] and tags[k - 1] != O and spans:
            spans[-1] = spans[-1][0], j
        else:
            spans.append((i, j))
    a, b, per = runs(_HEX[buf], offsets)
    has_hex = np.zeros(len(count), bool)
    doc = np.repeat(np.arange(len(count)), per)
    has_hex[doc[b - a >= 32]] = True
    data = buf.tobytes()
    out = []
    for k, (i, j) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        raw = data[i:j]
        low = raw.lower()
        patterns = [p for p, ok in zip(BASE, (any(x in low for x in _HINTS), b"AKIA" in raw, has_hex[k]), strict=True) if ok]
        spans: list[tuple[str, int, int]] = []
        if patterns or k in found:
            text = raw.decode()
            spans = [(kind, m.start(), m.end()) for kind, pattern, group, least in patterns for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
            base = sorted((p, q) for _, p, q in spans)
            for x, y in found.get(k, ()):
                while y < len(raw) and raw[y] in _ENDS:  # what pads a code, and a password's last signs
                    y += 1
                if y - x < LEAST:
                    continue
                x, y = len(raw[:x].decode()), len(raw[:y].decode())
                for p, q in base:
                    if x < q and p < y:
                        if x < p:
                            spans.append(("crf", x, p))
                        x = q
                if x < y:
                    spans.append(("crf", x, y))
            spans.sort(key=lambda s: (s[1], KINDS[s[0]], s[2]))
        out.append(spans)
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def with_spans(docs: DataFrame, field: Field, text_col: str = "text", name: str | None = None) -> DataFrame:
    """``docs`` with one more column, the last: an array of the secrets' spans. By default its name is a free one like ``spans``. One pass, no shuffle."""
    bounded_batches(docs.sparkSession)
    docs, name = room_for(docs, name, "spans")
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches, 128):
            spans = [[{"kind": k, "start": i, "end": j} for k, i, j in s] for s in scan(batch.column(text_col), sent.value)]
            yield batch.append_column(name, pa.array(spans, _SPANS))

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(name, SPANS)]))


def report(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf) for every row."""
    found = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), field, name="found")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s.kind == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")), F.sha2(said(F.filter("found", lambda s: s.kind != "crf")), 256).alias("base_sha256"), said(F.col("found")).alias("spans"), count("crf").alias("n_crf"))


def redacted(text: str | None, spans: list[tuple[str, int, int]], by: str) -> str | None:
    """``text`` with each stretch that spans cover replaced by ``by``; spans that overlap are one stretch."""
    if not text or not spans:
        return text
    out, at = [], 0
    for _, i, j in spans:
        if j > at:
            if i >= at:
                out += [text[at:i], by]
            at = j
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field, text_col: str = "text", by: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret, from its first base or field span on, replaced by ``by``. Columns as they are. One pass, no shuffle."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches, 128):
            k = batch.schema.get_field_index(text_col)
            texts = batch.column(k)
            spans = scan(texts, sent.value)
            hit = {row: redacted(texts[row].as_py(), found, by) for row, found in enumerate(spans) if found}
            if hit:
                texts = pa.array([hit.get(row, t) for row, t in enumerate(texts.to_pylist())], texts.type)
            yield batch.set_column(k, batch.schema.field(k), texts)

    return docs.mapInArrow(run, docs.schema)
