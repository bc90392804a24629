"""Secret scans: fixed patterns, and a convolutional network over every other candidate with its context."""

from __future__ import annotations

import functools
import hashlib
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamspark.llm.cnn import ByteCNN
from loamspark.llm.common import bound_batches, read, sliced, with_arrow_columns

# The base kinds in order, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
MODEL_KIND = "model"
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{8,}={0,2}")
DIGIT = re.compile(r"[0-9]")
ASSIGNED = re.compile(r"[:=]\s{0,3}[\"'`]?\Z")
#: Characters of context before and after, of a candidate in one window, and from one window of a long candidate to the next.
BEFORE, AFTER, BODY, STEP = 32, 16, 64, 48
#: Least recall that each threshold must keep; findings made for training, rounds over them.
RECALL, FINDINGS, EPOCHS = 0.98, 8000, 5
#: Byte values of the chain, characters of a text counted at once, texts made from it; steps of a unit of log odds, and the largest.
ASCII, CHAIN_CHARS, PROSE, STEPS, LARGEST = 128, 1 << 20, 2000, 64, 64
FAMILIES = ("digits", "hexadecimal", "letters", "mixed")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the fixed patterns, by start, then kind as listed."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    # A run is taken whole, so asking for 32 characters at once finds the same matches as filtering runs by length.
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> list[tuple[int, int]]:
    """Every run of eight or more token characters that holds a digit or follows a colon or an equals sign."""
    return [m.span() for m in CANDIDATE.finditer(text) if DIGIT.search(m[0]) or ASSIGNED.search(text, max(0, m.start() - 5), m.start())]


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """Bytes of the context before, the candidate and the context after, each part in its place; several windows cover a long candidate."""
    out = []
    for at in range(start, max(start + 1, end - BODY + STEP), STEP):
        stop = min(end, at + BODY)
        row = np.zeros(BEFORE + BODY + AFTER + 2, np.uint8)
        before = text[max(0, at - BEFORE) : at]
        for place, part in ((BEFORE - len(before), before), (BEFORE + 1, text[at:stop]), (BEFORE + BODY + 2, text[stop : stop + AFTER])):
            raw = np.frombuffer(part.encode("latin-1", "replace"), np.uint8)
            row[place : place + len(raw)] = raw
        row[BEFORE], row[BEFORE + 1 + BODY] = 1, 2
        out.append(row)
    return out


def family(body: str) -> int:
    """The place of body in FAMILIES: each family has its own threshold."""
    return 0 if body.isdigit() else 2 if not DIGIT.search(body) else 1 if re.fullmatch(r"[0-9a-fA-F]+", body) else 3


def made_findings(n: int, seed: int = 7, texts: tuple[str, ...] = ()) -> list[tuple[str, int, int, int]]:
    """n labelled findings (text, start, end, label) from a fixed generator: credentials of all families, and lookalikes.

    texts: prose to place them in; without any, prose is made up.
    """
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chars = lambda alphabet, a, b=0: "".join(alphabet[i] for i in rng.integers(len(alphabet), size=int(rng.integers(a, b)) if b else a))
    alnum, hexes, syllables = string.ascii_letters + string.digits, "0123456789abcdef", "etaoinshrdlu"
    word = lambda: chars(syllables, 3, 9)

    def prose() -> str:
        if texts and rng.integers(2):
            t = pick(texts)
            at = int(rng.integers(max(1, len(t) - 60)))
            return t[at : at + int(rng.integers(8, 60))]
        return " ".join(word() for _ in range(int(rng.integers(2, 7))))

    strong = ("auth", "bearer", "credential", "private_key", "client_secret", "access key", "access_key", "pwd", "db pwd", "passphrase", "pass", "passcode", "Authorization", "signing key", "webhook", "key", "api key", "login", "pin", "otp", "encryption_key", "PGPASS", "session key")
    weak = ("id", "order", "commit", "build", "version", "url", "see", "card", "ref", "path", "file", "invoice", "phone", "uuid", "date", "name", "title", "tel", "isbn", "sku", "note", "class", "lang", "page", "host", "user")
    secret = (
        lambda: chars(alnum + "+/", 20, 64), lambda: chars(hexes, 16, 31), lambda: pick(("ghp_", "sk_live_", "xoxb-", "AIza", "glpat-", "key-")) + chars(alnum, 32),
        lambda: "eyJ" + chars(alnum, 60, 160), lambda: chars(alnum, 14, 40), lambda: word() + chars(string.digits, 1, 4) + word() + word() + chars(string.digits, 1), lambda: chars(alnum + "_-", 8, 14) + pick("0123456789"),
        lambda: chars(string.digits, 8, 21), lambda: chars(string.digits, 8, 21), lambda: chars(string.ascii_letters, 12, 40), lambda: word() + word() + word() + word(), lambda: pick(("Correct", "my", "The", "open")) + word().title() + word().title(),
    )
    lookalike = (
        lambda: chars(string.digits, 8, 20), lambda: chars(string.digits, 13, 20), lambda: f"{chars(hexes, 8)}-{chars(hexes, 4)}-{chars(hexes, 4)}-{chars(hexes, 4)}-{chars(hexes, 12)}", lambda: f"{rng.integers(1990, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}",
        lambda: "/".join(word() for _ in range(4)) + "/" + str(rng.integers(1000)), lambda: word() + "_" + word() + str(rng.integers(100)), lambda: chars(syllables, 8, 16) + str(rng.integers(10)),
        lambda: pick("ae=-_") * int(rng.integers(8, 30)) + "0", lambda: chars(syllables, 8, 16), lambda: word() + word() + word(), lambda: chars(hexes, 16, 31), lambda: "//" + word() + "-" + word() + "/" + word(), lambda: f"{chars(string.digits, 3)}-{chars(string.digits, 4)}-{chars(string.digits, 4)}",
    )
    out = []
    for i in range(n):
        label = i % 2
        body = pick(secret if label else lookalike)()
        lead = pick(strong) + pick((": ", "=", " = ", ' = "', ": '")) if label else pick((pick(weak) + pick((": ", "=", " = ", ' = "', " #")), "", ""))
        if len(body) < 8 or (family(body) == 2 and not ASSIGNED.search(lead)):
            lead, body = lead or pick(weak) + ": ", body.ljust(8, "e")
        head = prose() + pick((" ", "\n")) + lead
        out.append((head + body + pick(("", '"', ".", ",")) + " " + prose(), len(head), len(head) + len(body), label))
    return out


def corpus_findings(texts: list[str]) -> list[tuple[str, int, int, int]]:
    """Candidates of texts that a fixed pattern covers, labelled 1. What no pattern covers is unlabelled and left out."""
    out = []
    for text in texts:
        known = base_spans(text)
        out += [(text, s, e, 1) for s, e in candidates(text) if any(a < e and s < b for a, b, _ in known)]
    return out


class SecretModel:
    """The network, its calibration (slope, offset) and the threshold of each family."""

    def __init__(self, network: ByteCNN, slope: float, offset: float, thresholds: dict[int, float]):
        self.network, self.slope, self.offset, self.thresholds = network, slope, offset, thresholds

    @classmethod
    def fit(cls, findings: list[tuple[str, int, int, int]], seed: int = 3) -> SecretModel:
        """Three quarters train; the rest calibrates the score and sets, by family, the highest threshold that keeps the recall."""
        findings = sorted(findings, key=lambda f: hashlib.sha256(repr((f[0][f[1] : f[2]], f[3])).encode()).digest())
        cut = len(findings) * 3 // 4
        # Of a long finding each window has the label: any stretch of a secret is one.
        made = [(w, f[3]) for f in findings[:cut] for w in windows(*f[:3])]
        network = ByteCNN(2, seed).fit(np.array([w for w, _ in made]), np.array([y for _, y in made]), EPOCHS, seed)
        model = cls(network, 1.0, 0.0, {})
        z, t = model._margins([f[:3] for f in findings[cut:]]), np.array([f[3] for f in findings[cut:]])
        for _ in range(25):  # Newton steps of a two-parameter logistic fit, slightly damped
            p = 1 / (1 + np.exp(-np.clip(model.slope * z + model.offset, -30, 30)))
            w = p * (1 - p) + 1e-6
            gradient = np.array([((t - p) * z).sum(), (t - p).sum()]) - 1e-3 * np.array([model.slope - 1, model.offset])
            curve = np.array([[(w * z * z).sum(), (w * z).sum()], [(w * z).sum(), w.sum()]]) + 1e-3 * np.eye(2)
            step = np.linalg.solve(curve, gradient)
            model.slope, model.offset = model.slope + step[0], model.offset + step[1]
        p = model._calibrated(z)
        kinds = np.array([family(f[0][f[1] : f[2]]) for f in findings[cut:]])
        for k in range(len(FAMILIES)):
            found = np.sort(p[(kinds == k) & (t == 1)])
            model.thresholds[k] = float(found[int((1 - RECALL) * len(found))]) if len(found) else 0.5
        return model

    def _margins(self, found: list[tuple[str, int, int]]) -> np.ndarray:
        """The network's log odds of each candidate: the largest of its windows'."""
        out = np.full(len(found), -np.inf)
        rows, owners = [], []

        def judge() -> None:
            logs = self.network.log_probabilities(np.array(rows)).astype(np.float64)
            np.maximum.at(out, owners, logs[:, 1] - logs[:, 0])
            rows.clear()
            owners.clear()

        for i, (text, start, end) in enumerate(found):
            for row in windows(text, start, end):
                rows.append(row)
                owners.append(i)
                if len(rows) == 4096:
                    judge()
        if rows:
            judge()
        return out

    def _calibrated(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -30, 30)))

    def scan(self, texts: list[str | None]) -> list[list[dict]]:
        """For each text its base spans, and candidates beside them that the network finds likely."""
        out, asked = [], []
        for i, text in enumerate(texts):
            base = base_spans(text or "")
            out.append([{"kind": k, "start": s, "end": e, "score": 1.0} for s, e, k in base])
            asked += [(i, s, e) for s, e in candidates(text or "") if not any(a < e and s < b for a, b, _ in base)]
        for at in range(0, len(asked), 4096):
            part = asked[at : at + 4096]
            p = self._calibrated(self._margins([(texts[i], s, e) for i, s, e in part]))
            for (i, s, e), score in zip(part, p, strict=True):
                if score >= self.thresholds[family(texts[i][s:e])]:
                    out[i].append({"kind": MODEL_KIND, "start": s, "end": e, "score": float(score)})
        order = (*KINDS, MODEL_KIND)
        return [sorted(x, key=lambda s: (s["start"], order.index(s["kind"]))) for x in out]


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])


def chain_counts(docs: DataFrame) -> np.ndarray:
    """How often each byte follows each two, over the whole texts of all documents (other than ASCII: a question mark)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(ASCII**3, np.int64)
        for part in (p for b in batches for p in sliced(b, 0)):
            for text in part.column(0).to_pylist():
                for at in range(0, len(text or ""), CHAIN_CHARS):  # parts overlap by two places
                    v = np.frombuffer(text[at : at + CHAIN_CHARS + 2].encode("ascii", "replace"), np.uint8).astype(np.int64)
                    if len(v) > 2:
                        codes, n = np.unique((v[:-2] * ASCII + v[1:-1]) * ASCII + v[2:], return_counts=True)
                        counts[codes] += n
        codes = np.flatnonzero(counts)
        for at in range(0, len(codes), 1 << 16):
            part = codes[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(counts[part], pa.int64())], names=["code", "n"])

    bound_batches(docs.sparkSession)
    out = np.zeros(ASCII**3, np.int64)
    for code, n in docs.select("text").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n")).collect():  # ASCII^3 rows at most
        out[code] = n
    return out.reshape(ASCII, ASCII, ASCII)


def made_prose(counts: np.ndarray, texts: int = PROSE, chars: int = 96, seed: int = 11) -> tuple[str, ...]:
    """Texts of a second-order chain with these counts; none without counts."""
    rng, pairs, out = np.random.default_rng(seed), counts.sum(2).cumsum(), []
    if not pairs[-1]:
        return ()
    follow = counts.cumsum(2)
    for draws in rng.random((texts, chars)):
        a, b = divmod(int(np.searchsorted(pairs, int(draws[0] * pairs[-1]), "right")), ASCII)
        made = [a, b]
        for x in draws[1:]:
            row = follow[a, b]
            if not row[-1]:
                break
            a, b = b, int(np.searchsorted(row, int(x * row[-1]), "right"))
            made.append(b)
        out.append(bytes(made).decode("ascii"))
    return tuple(out)


def known_margins(docs: DataFrame, model: SecretModel) -> dict[int, dict[int, int]]:
    """By family, how many of all documents' candidates that a fixed pattern covers have each log odds, in steps of 1 / STEPS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for part in (p for b in batches for p in sliced(b, 0)):
            found = [f[:3] for f in corpus_findings([x or "" for x in part.column(0).to_pylist()])]
            for at in range(0, len(found), 4096):
                some = found[at : at + 4096]
                steps = np.floor(np.clip(model._margins(some), -LARGEST, LARGEST) * STEPS).astype(int)
                counts.update(zip((family(x[s:e]) for x, s, e in some), steps.tolist(), strict=True))
        rows = [(k, z, n) for (k, z), n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.int64()))], names=["family", "step", "n"])

    out: dict[int, dict[int, int]] = {}
    bound_batches(docs.sparkSession)
    for k, z, n in docs.select("text").mapInArrow(run, "family int, step int, n long").groupBy("family", "step").agg(F.sum("n")).collect():  # few steps, whatever the table
        out.setdefault(k, {})[z] = n
    return out


def train(docs: DataFrame) -> SecretModel:
    """Fitted on the generator's findings, in made-up prose and in prose of a chain counted over all documents. The thresholds
    keep the recall on the generator's calibration fold and also on the labelled findings of all documents. An empty table
    leaves the generator alone."""
    model = SecretModel.fit(made_findings(FINDINGS, texts=made_prose(chain_counts(docs))))
    for k, steps in known_margins(docs, model).items():
        lost, total = 0, sum(steps.values())
        for z in sorted(steps):
            lost += steps[z]
            if lost > int((1 - RECALL) * total):  # the highest step that keeps the recall
                model.thresholds[k] = min(model.thresholds[k], float(model._calibrated(np.float64(z / STEPS))))
                break
    return model


def scan(docs: DataFrame, model: SecretModel, text: str = "text") -> DataFrame:
    """docs with secrets: an array of (kind, start, end, score), positions in code points, end exclusive.

    A null text counts as empty (no spans). A column named secrets is replaced, others pass through; equal texts get equal
    spans, repeated rows stay, an empty table stays empty.
    """
    return with_arrow_columns(docs, text, [T.StructField("secrets", T.ArrayType(SPAN))], functools.partial(_scanner, model))


def _scanner(model: SecretModel):
    return lambda texts: [model.scan(texts)]


def digest(spans):
    """kind:start:end of an array of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(docs))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"] != MODEL_KIND)
    return found.select("doc_id", *map(count, KINDS), F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("secrets")).alias("spans"), count(MODEL_KIND))
