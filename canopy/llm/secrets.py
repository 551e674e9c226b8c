"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds spans.

Tokens are words.  A token's score for *outside*, *begin* and *inside* of a secret sums weights of its own shape, of the
shapes of the two tokens before and the one after, and of the file; transitions add theirs, and Viterbi takes the best
tag sequence of the whole text.  The field is trained here by maximum likelihood (forward-backward, Adam): on windows of
at most ``TRAIN_DOCS`` documents whose words under the fixed patterns are labelled, half of them with invented secrets of
many forms written in.  That sample is the only bounded thing; every text is scanned whole.

Scanning costs little where nothing is near a secret: shapes are kept for each distinct word seen lately, and Viterbi
decodes only stretches of tokens that can gain by leaving *outside*, whatever their neighbours' tags (:meth:`SecretField.tags`);
the tags are those of the whole text.

Spans found by the field lose quotes and punctuation at their ends, have the kind ``crf`` and give way to base spans that
they overlap.

Defined results: a null text is empty and has no spans; a null id passes through; repeated rows are scanned one by one;
an empty table trains on invented secrets alone and gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.words import bounded_batches, slices, trimmed, utf8

#: Fixed patterns: kind, pattern, group whose length counts, least length.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "crf")
LEAST = {"assign": 6, "access": 20, "hex": 24}
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"api")
WORD = re.compile(r"[^\x20\x09-\x0D]+")

TRAIN_DOCS, TRAIN_WORDS = 400, 100
#: Characters of a word that training looks at.
_LONGEST = 512
REDACTED = "[SECRET]"
#: Words near which secrets stand.
KEY_WORDS = frozenset(b"password passwd pwd pass passphrase secret secrets token tokens apikey api_key key keys auth authorization bearer credential credentials access_key secret_key private_key client_secret".split())
OUT, BEGIN, INSIDE = range(3)
_ROLES = (0, 1, 2, -1)  # own, one before, two before, one after
_NEVER = -1e4


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the fixed patterns, by start and then kind."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    # A run of hexadecimal digits of 24 or more: what is left of the maximal runs after the length test.
    out += [(m.start(), m.end(), "hex") for m in _LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# --- features ---------------------------------------------------------------------------------------------------------

_SHAPE = bytes.maketrans(bytes(range(256)), bytes(0x61 if 97 <= c <= 122 or c >= 128 else 0x41 if 65 <= c <= 90 else 0x30 if 48 <= c <= 57 else c for c in range(256)))
_EDGE = b"\"'`,.;:()[]{}<>!?=|*#$%&"
_HEX_RUN = re.compile(rb"[0-9a-f]{16,}|[0-9A-F]{16,}")
_CODE = re.compile(rb"[A-Za-z0-9+/_=-]{16,}")
_ASSIGNING = re.compile(rb"(?i)(pass|pwd|secret|token|key|auth)[\"']?[:=].")
FEATURES = (
    "bias len<=3 len4-7 len8-11 len12-15 len16-23 len24-39 len40+ lower title upper alpha digits alnum digits1-3 digits4+ mixed varied hex code keyword assigning "
    "ends: ends= alone= quote_start quote_end akia at slash dash dot url paren edge_digit upper3digit2 pem"
).split()
_INDEX = {name: i for i, name in enumerate(FEATURES)}
_N = len(FEATURES)
FILE_FEATURES = ("has_keyword", "short")


def word_features(word: bytes) -> np.ndarray:
    """Which of ``FEATURES`` hold for a word."""
    out = np.zeros(_N, bool)
    core = word.strip(_EDGE)
    shape = core.translate(_SHAPE)
    n, digits, uppers, lowers = len(core), shape.count(b"0"), shape.count(b"A"), shape.count(b"a")
    alpha = digits == 0 and uppers + lowers == n
    sizes = ((3, "len<=3"), (7, "len4-7"), (11, "len8-11"), (15, "len12-15"), (23, "len16-23"), (39, "len24-39"))
    on = ["bias", next((name for most, name in sizes if n <= most), "len40+")]
    on += [name for name, holds in (
        ("lower", alpha and n and uppers == 0), ("title", alpha and uppers == 1 and shape[:1] == b"A"), ("upper", alpha and uppers > 1 and lowers == 0), ("alpha", alpha),
        ("digits", n and digits == n), ("alnum", digits and uppers + lowers and digits + uppers + lowers == n), ("digits1-3", 1 <= digits <= 3), ("digits4+", digits >= 4),
        ("mixed", lowers >= 2 and uppers >= 2 and digits >= 1), ("varied", n >= 10 and len(set(core)) >= 9 and digits >= 2 and uppers + lowers >= 2), ("hex", digits and digits < n and _HEX_RUN.search(core)), ("code", digits and uppers + lowers and _CODE.search(core)),
        ("keyword", core.lower() in KEY_WORDS), ("assigning", _ASSIGNING.search(word)), ("ends:", word.endswith(b":")), ("ends=", word.endswith(b"=") and n), ("alone=", word in (b"=", b":", b":=", b"=>")),
        ("quote_start", word[:1] in (b'"', b"'", b"`")), ("quote_end", word[-1:] in (b'"', b"'", b"`")), ("akia", core.startswith((b"AKIA", b"ghp_", b"sk-", b"sk_", b"xox", b"eyJ"))), ("at", b"@" in core), ("slash", b"/" in core), ("dash", b"-" in core),
        ("dot", b"." in core), ("url", b"://" in core), ("paren", b"(" in word or b"+" in word[:1]), ("edge_digit", shape[:1] == b"0"), ("upper3digit2", uppers >= 3 and digits >= 2), ("pem", word.startswith(b"-----")),
    ) if holds]
    for name in on:
        out[_INDEX[name]] = True
    return out


def _file_features(keyword: bool, n_words: int) -> list[float]:
    return [float(keyword), float(n_words < 100)]


class SecretField:
    """Weights: ``own[role, feature, tag]``, ``file[feature, tag]``, ``turn[tag, tag]``."""

    def __init__(self, own: np.ndarray, file: np.ndarray, turn: np.ndarray) -> None:
        self.own, self.file, self.turn = own, file, turn

    def emissions(self, table: np.ndarray, index: np.ndarray, file: Sequence[float]) -> np.ndarray:
        """Scores of the tags of one text; ``table[word, role, tag]``."""
        out = table[index, 0] + np.asarray(file) @ self.file
        out[1:] += table[index[:-1], 1]
        out[2:] += table[index[:-2], 2]
        out[:-1] += table[index[1:], 3]
        return out

    def viterbi(self, emissions: np.ndarray, from_out: bool = False, to_out: bool = False) -> np.ndarray:
        """Best tags of one text, or of a part that follows (``from_out``) or precedes (``to_out``) a word outside."""
        n = len(emissions)
        back = np.zeros((n, 3), np.int8)
        turn = self.turn.tolist()
        rows = emissions.tolist()
        o, b, i = (x + y for x, y in zip(rows[0], turn[OUT] if from_out else (0.0, 0.0, _NEVER), strict=True))
        for t in range(1, n):
            e = rows[t]
            nxt = []
            for to in range(3):
                x, y, z = o + turn[0][to], b + turn[1][to], i + turn[2][to]
                if x >= y and x >= z:
                    nxt.append(x + e[to])
                elif y >= z:
                    nxt.append(y + e[to])
                    back[t, to] = 1
                else:
                    nxt.append(z + e[to])
                    back[t, to] = 2
            o, b, i = nxt
        tags = np.zeros(n, np.int8)
        tags[-1] = int(np.argmax([x + (turn[k][OUT] if to_out else 0.0) for k, x in enumerate((o, b, i))]))
        for t in range(n - 1, 0, -1):
            tags[t - 1] = back[t, tags[t]]
        return tags

    def slack(self) -> float:
        """Most that a word of a secret gains on average from transitions, as against all words outside.

        A secret of n words has n - 1 transitions inside and at most one into it and one out of it, each in place of one
        between words outside; so its gain is at most ``ends + (n - 1) * inner``, which is n times the larger or less.
        """
        turn = self.turn - self.turn[OUT, OUT]
        into, out = turn[OUT, BEGIN], max(turn[BEGIN, OUT], turn[INSIDE, OUT])
        ends = max(0.0, into, out, into + out)
        return float(max(ends, turn[1:, 1:].max()))

    def tags(self, emissions: np.ndarray, slack: float) -> np.ndarray:
        """The tags that :meth:`viterbi` gives the whole text, by decoding only words that a secret may hold.

        A secret gains at most the sum of its words' own gains and the slack of each.  So a word that is in no stretch of
        words with a positive sum is outside.
        """
        gain = emissions[:, 1:].max(axis=1) - emissions[:, 0] + slack
        total = np.r_[0.0, np.cumsum(gain)]
        before, after = np.minimum.accumulate(total[:-1]), np.maximum.accumulate(total[:0:-1])[::-1]
        maybe = np.r_[False, after - before > -1e-9, False]
        out = np.zeros(len(emissions), np.int8)
        for low, high in np.flatnonzero(maybe[1:] != maybe[:-1]).reshape(-1, 2).tolist():
            out[low:high] = self.viterbi(emissions[low:high], low > 0, high < len(emissions))
        return out


# --- training ---------------------------------------------------------------------------------------------------------

_HEXES, _CODES, _CAPS = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def _invented(rng: np.random.Generator) -> list[tuple[str, int]]:
    """A secret of a random form as words with tags."""
    word = lambda letters, low, high: "".join(rng.choice(list(letters), rng.integers(low, high)))
    value = (lambda: word(_HEXES, 20, 65), lambda: word(_CODES, 16, 48), lambda: word(_CODES, 8, 14) + str(rng.integers(10, 99)) + "_x", lambda: "ghp_" + word(_CODES, 30, 37), lambda: "sk-" + word(_CODES, 24, 40), lambda: "eyJ" + word(_CODES, 12, 30) + "." + word(_CODES, 20, 40),
        lambda: word(_CODES, 6, 16) + str(rng.choice(list("@#%*^&"))) + word(_CODES, 3, 8), lambda: word("abcdefghijklmnoprst", 2, 7) + str(rng.choice(["-", "_"])) + word(_CODES, 16, 36), lambda: word(_CODES, 18, 44) + "=" * int(rng.integers(1, 3)))[rng.integers(9)]()
    name = str(rng.choice(["password", "passwd", "secret", "token", "api_key", "apikey", "client_secret", "auth", "key", "pwd", "access_key"]))
    name = name.upper() if rng.random() < 0.2 else name
    form = rng.integers(9)
    if form == 8:
        return [(name, OUT), *((str(rng.choice(["is", "was", "for", "of", "this:", "here:"])), OUT) for _ in range(rng.integers(1, 3))), (value, BEGIN)]
    if form == 0:
        return [(name, OUT), ("=", OUT), (f'"{value}"', BEGIN)]
    if form == 1:
        return [(f"{name}:", OUT), (value, BEGIN)]
    if form == 2:
        return [(f"{name}={value}", BEGIN)]
    if form == 3:
        return [("AKIA" + word(_CAPS, 16, 17), BEGIN)]
    if form == 4:
        return [("Authorization:", OUT), ("Bearer", OUT), (value, BEGIN)]
    if form == 5:
        return [(word(_HEXES, 24, 65), BEGIN)]
    if form == 6:
        head = [("-----BEGIN", BEGIN), ("RSA", INSIDE), ("PRIVATE", INSIDE), ("KEY-----", INSIDE)]
        return [*head, *((word(_CODES, 40, 65), INSIDE) for _ in range(rng.integers(2, 5))), ("-----END", INSIDE), ("RSA", INSIDE), ("PRIVATE", INSIDE), ("KEY-----", INSIDE)]
    return [(name, OUT), (str(rng.choice(["is", "was", ":="])), OUT), (value, BEGIN)]


def _decoy(rng: np.random.Generator) -> list[tuple[str, int]]:
    """Words that look odd but are no secrets: addresses, host and file names, numbers, dates, versions, identifiers."""
    pick = lambda letters, low, high: "".join(rng.choice(list(letters), int(rng.integers(low, high))))
    d = lambda low, high=None: pick("0123456789", low, (high or low) + 1)
    name = lambda: pick("aeiourstnlhm", 2, 10)
    joint = lambda: str(rng.choice([".", "_", "-", ""]))
    ending = lambda: str(rng.choice(["org", "com", "net", "de", "fr", "example"]))
    host = lambda: f"{name()}{d(0, 2)}.{name()}.{ending()}"
    forms = (
        lambda: [f"{name()}{joint()}{d(1, 4)}@{host()}"], lambda: [f"{name()}.{name()}@{host()}" + str(rng.choice(["", ",", "."]))], lambda: [f"{name()}{d(2, 3)}@{name()}{d(1)}.example.{ending()}"],
        lambda: [host()], lambda: [f"https://{host()}/{name()}/{d(3, 5)}-{name()}.html"], lambda: [f"/{name()}/{name()}/{name()}{d(1, 3)}.txt"],
        lambda: [f"+{d(2)}", f"({d(3)})", f"{d(3)}-{d(4)}"], lambda: [".".join(d(1, 3) for _ in range(4))], lambda: [d(4, 20)], lambda: [d(14, 25) + "."], lambda: ["-".join([d(3), d(2), d(4)])], lambda: [" ".join(d(4) for _ in range(4))],
        lambda: [f"{d(4)}-{d(2)}-{d(2)}"], lambda: [f"{d(2)}:{d(2)}:{d(2)}"], lambda: [f"{name().title()}{name().title()}{d(1, 3)}"], lambda: [f"{name()}_{name()}_{d(1, 3)}"], lambda: ["the", "token", "of"], lambda: ["a", "secret", "garden"], lambda: ["key", "to", "the"], lambda: ["Version", f"{d(1)}.{d(1)}.{d(1, 2)}"],
    )
    return [(x, OUT) for word in forms[rng.integers(len(forms))]() for x in word.split()]


def _labelled(text: str) -> list[tuple[str, int]]:
    """Words of a text; those that hold a base span's value begin a secret."""
    values = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= LEAST["assign"]:
            values.append(m.span(2))
    values += [(a, b) for a, b, kind in base_spans(text) if kind != "assign"]
    values.sort()
    out, at = [], 0
    for m in WORD.finditer(text):
        while at < len(values) and values[at][1] <= m.start():
            at += 1
        out.append((m[0], BEGIN if at < len(values) and values[at][0] < m.end() else OUT))
    return out


def _window(words: list[tuple[str, int]], rng: np.random.Generator) -> list[tuple[str, int]]:
    """At most ``TRAIN_WORDS`` of the words, often such that the first marked one is among them."""
    if len(words) <= TRAIN_WORDS:
        return words
    marked = [i for i, (_, tag) in enumerate(words) if tag]
    low = int(rng.integers(len(words) - TRAIN_WORDS + 1))
    if marked and rng.random() < 0.7:
        low = min(max(0, marked[0] - int(rng.integers(TRAIN_WORDS))), len(words) - TRAIN_WORDS)
    return words[low : low + TRAIN_WORDS]


def training_sequences(texts: Sequence[str | list[tuple[str, int]]], seed: int = 7) -> list[list[tuple[str, int]]]:
    """Windows of labelled words (of texts, or as given), with invented secrets and decoys written into most of them."""
    rng = np.random.default_rng(seed)
    out = []
    plain = ["the", "of", "and", "in", "value", "then", "line.", "with", "word,", "A", "for"]
    for text in [*texts, *([None] * 60)]:
        words = [(str(rng.choice(plain)), OUT) for _ in range(40)] if text is None else _window(_labelled(text), rng) if isinstance(text, str) else text
        if not words:
            continue
        for make, chance in ((_invented, 0.5), (_decoy, 0.6), (_decoy, 0.3)):
            if rng.random() < chance:
                at = 0 if rng.random() < 0.2 else int(rng.integers(len(words) + 1))  # often where a text begins
                while at < len(words) and words[at][1] == INSIDE:
                    at += 1
                words = [*words[:at], *make(rng), *words[at:]]
        out.append(words)
    return out


def train(sequences: list[list[tuple[str, int]]], rounds: int = 100, rate: float = 0.15, decay: float = 1e-3) -> SecretField:
    """Maximum likelihood with a quadratic penalty, by Adam on the full gradient."""
    vocabulary: dict[str, int] = {"": 0}
    n, most = len(sequences), max(map(len, sequences))
    index, tags, mask = np.zeros((n, most), np.int64), np.zeros((n, most), np.int64), np.zeros((n, most), bool)
    file = np.zeros((n, len(FILE_FEATURES)))
    for k, words in enumerate(sequences):
        for t, (word, tag) in enumerate(words):
            index[k, t], tags[k, t], mask[k, t] = vocabulary.setdefault(word, len(vocabulary)), tag, True
        file[k] = _file_features(any(w.encode().strip(_EDGE).lower() in KEY_WORDS for w, _ in words), len(words))
    features = np.stack([np.zeros(_N, bool), *(word_features(w.encode()) for w in list(vocabulary)[1:])]).astype(np.float64)
    shifted = []
    for role in _ROLES:
        x = np.zeros_like(index)
        if role >= 0:
            x[:, role:] = index[:, : most - role]
        else:
            x[:, :-1] = index[:, 1:]
        shifted.append(np.where(mask, x, 0))
    weights = [np.zeros((len(_ROLES), _N, 3)), np.zeros((len(FILE_FEATURES), 3)), np.zeros((3, 3))]
    weights[0][0, _INDEX["bias"], OUT] = 2.0
    closed = np.zeros((3, 3))
    closed[OUT, INSIDE] = _NEVER
    first = np.array([0.0, 0.0, _NEVER])
    gold = np.eye(3)[tags] * mask[..., None]
    turns = np.einsum("kti,ktj->ij", gold[:, :-1], gold[:, 1:])
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    high = lambda x: x.max(axis=-1, keepdims=True)
    for step in range(1, rounds + 1):
        own, of_file, turn = weights
        emit = sum((features @ own[r])[shifted[r]] for r in range(len(_ROLES))) + (file @ of_file)[:, None, :]
        full = turn + closed
        ahead, behind = np.zeros((n, most, 3)), np.zeros((n, most, 3))
        ahead[:, 0] = emit[:, 0] + first
        for t in range(1, most):
            x = ahead[:, t - 1, :, None] + full
            peak = x.max(axis=1)
            ahead[:, t] = np.where(mask[:, t, None], emit[:, t] + peak + np.log(np.exp(x - peak[:, None]).sum(axis=1)), ahead[:, t - 1])
        for t in range(most - 2, -1, -1):
            x = full + (emit[:, t + 1] + behind[:, t + 1])[:, None, :]
            peak = high(x)
            behind[:, t] = np.where(mask[:, t + 1, None], (peak + np.log(np.exp(x - peak).sum(axis=-1, keepdims=True)))[..., 0], 0.0)
        total = ahead[:, -1]
        logz = (high(total)[:, 0] + np.log(np.exp(total - high(total)).sum(axis=1)))[:, None]
        p = np.exp(ahead + behind - logz[..., None]) * mask[..., None]
        both = np.exp(np.minimum(ahead[:, :-1, :, None] + full + (emit + behind)[:, 1:, None, :] - logz[..., None, None], 0.0)) * mask[:, 1:, None, None]
        off = p - gold
        flat = off.reshape(-1, 3)
        g_own = np.stack([features.T @ np.stack([np.bincount(s.reshape(-1), flat[:, c], len(features)) for c in range(3)], axis=1) for s in shifted])
        gradients = [g_own / n + decay * own, np.einsum("kf,ktc->fc", file, off) / n + decay * of_file, (both.sum(axis=(0, 1)) - turns) / n + decay * turn]
        gradients[2][OUT, INSIDE] = 0.0
        for w, g, m in zip(weights, gradients, moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            w -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return SecretField(weights[0], weights[1], weights[2] + closed)


def train_on(documents: DataFrame, docs: int = TRAIN_DOCS) -> SecretField:
    """A field trained on windows of at most ``docs`` documents, those of least hash of their id.

    Hashes alone are sorted; the windows are cut where the texts are, so at most ``docs * TRAIN_WORDS`` words come here.
    """
    identity = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = documents.select(F.xxhash64(identity).alias("h"), identity.alias("id"), "text")
    chosen = rows.select("h").distinct().orderBy("h").limit(docs).agg(F.max("h").alias("last")).first()["last"]
    if chosen is None:
        return train(training_sequences([]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                window = _window(_labelled(text or ""), np.random.default_rng(h & 0xFFFFFFFF))
                found.append((h, [w[:_LONGEST] for w, _ in window], [tag for _, tag in window]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), (pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32())), strict=True)], names=["h", "words", "tags"])

    windows = rows.where(F.col("h") <= chosen).select("h", "text").mapInArrow(trimmed(run), "h long, words array<string>, tags array<int>")
    one = windows.groupBy("h").agg(F.min(F.struct("words", "tags")).alias("w")).orderBy("h")  # one window of rows that repeat an id
    return train(training_sequences([list(zip(r["w"]["words"], r["w"]["tags"], strict=True)) for r in one.collect()]))


# --- scanning ---------------------------------------------------------------------------------------------------------


class _Shapes(dict):
    """Row of each word seen lately in a table of scores by role and tag, which is emptied when it is full."""

    LIMIT = 1 << 17

    def __init__(self, field: SecretField) -> None:
        super().__init__()
        self._field = field
        self._kinds: dict[bytes, int] = {}
        self._plain: dict[tuple[int, bool, bool], int] = {}
        self._rows: list[np.ndarray] = []
        self.suspect: list[bool] = []
        self.keyword: list[bool] = []
        self.table = np.zeros((0, len(_ROLES), 3))
        self.flags = np.zeros((0, 2), bool)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        core = word.rstrip(b",.;!?")
        if core.isalpha() and (core.islower() or core.istitle()) and core.lower() not in KEY_WORDS:
            # Plain words differ in length and first letter alone.
            kind = (len(core), core[0] < 97, len(word) >= 20)
            row = self._plain.get(kind)
            if row is None:
                row = self._plain[kind] = self._row(word)
        else:
            row = self._row(word)
        self[word] = row
        return row

    def _row(self, word: bytes) -> int:
        features = word_features(word)
        key = features.tobytes() + bytes([len(word) >= 20])
        row = self._kinds.get(key)
        if row is None:
            row = self._kinds[key] = len(self._rows)
            self._rows.append(np.einsum("f,rfc->rc", features.astype(float), self._field.own))
            self.suspect.append(len(word) >= 20)
            self.keyword.append(bool(features[_INDEX["keyword"]]))
        return row

    def refresh(self) -> None:
        """Rows are one for each set of features, so there are few and they are never dropped."""
        if len(self.table) < len(self._rows):
            self.table = np.stack(self._rows)
            self.flags = np.stack([self.suspect, self.keyword], axis=1)


class Scanner:
    """Spans of texts under a field."""

    def __init__(self, field: SecretField) -> None:
        self.field, self.shapes = field, _Shapes(field)
        self.slack = field.slack()

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, str]]]:
        """For each text all its spans, base and added, by start and then kind."""
        words = [x.split() for x in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        starts = np.r_[0, np.cumsum(sizes)]
        index = np.fromiter((self.shapes[w] for own in words for w in own), np.int64, int(starts[-1]))
        self.shapes.refresh()
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if not len(index):
            return out
        table, flags = self.shapes.table, self.shapes.flags
        own = np.repeat(np.arange(len(texts)), sizes)
        suspect = np.bincount(own[flags[index, 0]], minlength=len(texts)) > 0
        keyword = np.bincount(own[flags[index, 1]], minlength=len(texts)) > 0
        file = np.array([_file_features(k, n) for k, n in zip(keyword.tolist(), sizes.tolist(), strict=True)]) @ self.field.file
        gain = table[:, :, 1:] - table[:, :, :1]
        score = gain[index, 0] + (file[:, 1:] - file[:, :1])[own]
        for role, by in ((1, 1), (2, 2)):
            same = own[by:] == own[:-by]
            score[by:][same] += gain[index[:-by][same], role]
        same = own[1:] == own[:-1]
        score[:-1][same] += gain[index[1:][same], 3]
        likely = np.bincount(own[score.max(axis=1) + self.slack > -1e-9], minlength=len(texts)) > 0
        for k, text in enumerate(texts):
            lowered = text.lower() if not suspect[k] else b""
            if not (suspect[k] or likely[k] or any(x in lowered for x in _ASSIGN_WORDS)):
                continue
            decoded = text.decode()
            spans = base_spans(decoded)
            if likely[k]:
                low, high = starts[k], starts[k + 1]
                emissions = self.field.emissions(table, index[low:high], _file_features(bool(keyword[k]), int(sizes[k])))
                tags = self.field.tags(emissions, self.slack)
                spans += self._added(decoded, tags, spans)
                spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
            out[k] = spans
        return out

    @staticmethod
    def _added(text: str, tags: np.ndarray, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        if not tags.any():
            return []
        found: list[list[int]] = []
        for tag, m in zip(tags.tolist(), WORD.finditer(text), strict=True):
            if tag == BEGIN:
                found.append([m.start(), m.end()])
            elif tag == INSIDE:
                found[-1][1] = m.end()
        edge = _EDGE.decode()
        out = []
        for start, end in found:
            inner = text[start:end]
            start += len(inner) - len(inner.lstrip(edge))
            end -= len(inner) - len(inner.rstrip(edge))
            if start < end and not any(a < end and start < b for a, b, _ in base):
                out.append((start, end, "crf"))
        return out


def render(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span, overlapping ones together, replaced by ``REDACTED``."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], REDACTED]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(documents: DataFrame, field: SecretField | None = None, keep: Sequence[str] = (), with_text: bool = False) -> DataFrame:
    """For each row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``, ``redacted`` (null unless ``with_text``) and
    the columns ``keep``."""
    spark = documents.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(field or train_on(documents))
    kept = documents.select(*keep).schema
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(sent.value)
        for batch in batches:
            texts, ids = utf8(batch.column(1)), batch.column(0)
            for low, high in slices(texts, 1 << 20):
                found = scanner.spans(texts[low:high])
                base = [[s for s in spans if s[2] != "crf"] for spans in found]
                counts = [pa.array([sum(s[2] == kind for s in spans) for spans in base], pa.int64()) for kind in KINDS[:3]]
                digests = pa.array([hashlib.sha256(render(spans).encode()).hexdigest() for spans in base], pa.string())
                text = [redact(x.decode(), spans) if spans else x.decode() for x, spans in zip(texts[low:high], found, strict=True)] if with_text else [None] * (high - low)
                rest = [batch.column(2 + k).slice(low, high - low) for k in range(len(kept))]
                yield pa.RecordBatch.from_arrays([ids.slice(low, high - low), *counts, digests, pa.array([render(s) for s in found], pa.string()), pa.array(text, pa.string()), *rest], names=[*names, *kept.names])

    ddl = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in kept)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep).mapInArrow(trimmed(run), ddl)
