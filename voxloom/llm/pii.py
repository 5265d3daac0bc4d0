r"""Personal data: candidate generators, boosted trees on format and context, calibrated thresholds.

Only DataFrame functions touch the documents.  The four base kinds are found by pattern and check
and always stay.  Further generators propose spans with high recall, overlaps included; each
gets a score from boosted trees, which are fitted on generated, labelled texts (TRAIN_ROWS of
them, their features taken by the same expressions) and written out as SQL.  Scores are calibrated by
isotonic regression on texts from other generators, with other contexts and shapes, and a kind's
threshold lies half way under the least score whose calibrated chance reaches PRECISION.  A proposal is selected if it
passes, and overlaps no base span and no better proposal.

Positions come from splitting at a pattern: gaps and matches alternate, so their lengths in code
points add up.  The patterns are possessive and anchored at the start of a run (or the end of
the match before, ``\G``), which finds the same matches in linear time and without recursion.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Base kinds in order; pattern, and what a text needs to hold to be searched.
BASE = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", None),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
#: Generators of further kinds: a pattern, anything whose context may make it personal or secret.
MORE = {
    "secret": r"(?<![A-Za-z0-9_])(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,40}|sk-[A-Za-z0-9]{16,64}|[A-Za-z0-9_/+-]{0,200}[0-9][A-Za-z0-9_/+-]{7,200})(?![A-Za-z0-9_])",
    "tel": r"(?<![\w+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-])",
    "ssn": r"(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "credential": r"(?<=(?i:password|passwd|passphrase|passwort|pwd|secret|token|api[_ -]?key|access[_ -]?key|credentials?)[\"' ]{0,2}[=:][\"' ]{0,2})[^\s\"'<>,;]{6,200}",
    "mail": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,40} ?[\[(]at[\])] ?[A-Za-z0-9-]{2,40}(?: ?[\[(]dot[\])] ?[A-Za-z]{2,10}){1,3}",
}
KINDS = [*BASE, *MORE]
SPAN = "array<struct<s:int,e:int,m:string>>"
FEATURES = ["kind", "len", "digit", "upper", "lower", "punct", "mixed", "hex", "key", "assign", "tel_word", "id_word", "plain_word", "quote", "words", "year"]
TRAIN_ROWS, TREES, RATE, PRECISION = 2600, 24, 0.3, 0.9
#: What a text must hold for credentials to be looked for.
NAMED = r"(?i)(?:passw|passphrase|pwd|secret|token|key|credential)[^\n]{0,8}[=:]"
KEY_WORDS = r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api.?key|access.?key|credential|auth)\W{0,4}$"
TEL_WORDS = r"(?i)(?:call|phone|tel|mobile|fax|cell|whatsapp)\W{0,4}(?:\w+\W{0,3}){0,2}$"
ID_WORDS = r"(?i)(?:ssn|social security|tax id|iban|account|konto|compte|cuenta)\W{0,4}(?:\w+\W{0,3}){0,2}$"
PLAIN_WORDS = r"(?i)(?:commit|version|order|invoice|article|isbn|part|model|build|page|figure|sha|checksum|ticket|issue|id)\W{0,4}(?:\w+\W{0,3}){0,1}$"


def _spans(text: str, pattern: str, when: Column) -> tuple[Column, Column]:
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    return F.when(when, found), F.when(when, F.split(F.col(text), pattern, -1))


LUHN = (
    "aggregate(sequence(1, length(d)), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN CAST(substring(d, length(d) - i + 1, 1) AS INT) "
    "ELSE CAST(substring(d, length(d) - i + 1, 1) AS INT) * 2 - IF(substring(d, length(d) - i + 1, 1) > '4', 9, 0) END) % 10 = 0"
)
CHECKS = {
    "email": "true",
    "ip": "forall(split(x.m, '[.]'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(ltrim('0', p) AS INT), 0) <= 255)",
    "card": f"exists(array(translate(x.m, ' -', '')), d -> length(d) BETWEEN 14 AND 19 AND {LUHN})",
    "phone": "length(translate(x.m, '+ ().-', '')) BETWEEN 10 AND 15",
}


def _generated(rows: DataFrame, kinds: dict[str, tuple[str, Column]], keep: list[str]) -> DataFrame:
    """Adds ``k_<kind>``: the placed matches of each pattern."""
    out = rows
    for kind, (pattern, when) in kinds.items():
        found, gaps = _spans("t", pattern, when)
        out = out.withColumn(f"m_{kind}", found).withColumn(f"g_{kind}", gaps)
    cols = [F.col(c) for c in keep]
    for kind in kinds:
        fold = (
            f"aggregate(arrays_zip(g_{kind}, m_{kind}), named_struct('p', 0, 'out', CAST(array() AS {SPAN})), "
            f"(a, x) -> named_struct('p', a.p + char_length(x.g_{kind}) + coalesce(char_length(x.m_{kind}), 0), 'out', IF(x.m_{kind} IS NULL, a.out, "
            f"concat(a.out, array(named_struct('s', a.p + char_length(x.g_{kind}), 'e', a.p + char_length(x.g_{kind}) + char_length(x.m_{kind}), 'm', x.m_{kind}))))), a -> a.out)"
        )
        cols.append(F.coalesce(F.expr(fold), F.expr(f"CAST(array() AS {SPAN})")).alias(f"k_{kind}"))
    return out.select(*cols)


def _features() -> str:
    """SQL of the features of span x (s, e, m) of text t, of the kind numbered x.k."""
    share = "(length(x.m) - length(regexp_replace(x.m, '{0}', ''))) / length(x.m)"
    before = "substring(t, greatest(1, x.s - 31), least(x.s, 32))"
    parts = {
        "kind": "x.k", "len": "length(x.m)", "digit": share.format("[0-9]"), "upper": share.format("[A-Z]"), "lower": share.format("[a-z]"),
        "punct": share.format("[^A-Za-z0-9]"), "mixed": "int(x.m RLIKE '[0-9][A-Za-z]') + int(x.m RLIKE '[A-Za-z][0-9]')", "hex": "int(x.m RLIKE '^[0-9a-f]+$')",
        "key": f"int({before} RLIKE r\"{KEY_WORDS}\")", "assign": f"int({before} RLIKE '[=:] ?[\"\\']?$')", "tel_word": f"int({before} RLIKE r\"{TEL_WORDS}\")",
        "id_word": f"int({before} RLIKE r\"{ID_WORDS}\")", "plain_word": f"int({before} RLIKE r\"{PLAIN_WORDS}\")", "quote": f"int({before} RLIKE '[\"\\']$')",
        "words": "int(x.m RLIKE '^[A-Z]?[a-z]+(?:[-_/.][A-Z]?[a-z]+|[-_/.][0-9]{1,4})*[-_/.]*$')", "year": "int(x.m RLIKE '(?:^|[^0-9])(?:19|20)[0-9]{2}(?:[^0-9]|$)')",
    }
    return "named_struct(" + ", ".join(f"'{k}', double({parts[k]})" for k in FEATURES) + ")"


#: Contexts of the generators: those that train, those that calibrate and those that test.
LEADS = (
    {"key": ["password=", "token = ", "api_key: ", "secret=", "passwd: ", "pwd=", "access_key="], "plain": ["commit ", "sha ", "version ", "part ", ""], "call": ["call ", "phone: ", "tel ", ""], "deal": ["order ", "part ", "invoice ", "isbn "], "id": ["ssn ", "tax id ", ""], "bank": ["iban ", "account ", ""]},
    {"key": ["Password: ", "auth token=", "API key: ", "client_secret = ", "passphrase="], "plain": ["checksum ", "model ", "build ", "order ", ""], "call": ["mobile ", "fax: ", "Phone ", ""], "deal": ["ticket ", "article ", "order ", "model "], "id": ["social security ", "SSN: ", ""], "bank": ["konto ", "IBAN: ", ""]},
    {"key": ["password is set, password=", "bearer token: ", "my api-key=", "credentials: ", "SECRET="], "plain": ["id ", "page ", "issue ", "commit ", ""], "call": ["call me: ", "cell ", "whatsapp ", ""], "deal": ["invoice ", "issue ", "isbn ", "part "], "id": ["tax id: ", "ssn=", ""], "bank": ["cuenta ", "compte ", ""]},
)


def _examples(seed: int, n: int, family: int = 0) -> list[tuple[int, str, str, float]]:
    """Generated texts (id, text, kind, label): one planted span each, in the middle of words.

    ``family`` picks contexts and shapes, so that what calibrates or tests is not what was trained on.
    """
    r = random.Random(seed)
    low, up, dig, lead = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", LEADS[family]
    sep, more = ("-", "_", ".")[family], (0, 3, 5)[family]

    def s(alphabet: str, k: int) -> str:
        return "".join(r.choices(alphabet, k=k))

    def words(k: int, glue: str = " ") -> str:
        return glue.join(s(low, r.randint(2, 9)) for _ in range(k))

    def key() -> str:
        return r.choice(lead["key"]) + r.choice(["", '"', "'"])

    makers = [
        ("secret", 1.0, lambda: ("", r.choice(["AKIA", "ASIA"]) + s(up + dig, 16))),
        ("secret", 1.0, lambda: ("", r.choice(["ghp_", "sk-", "gho_"]) + s(low + up + dig, 32 + more))),
        ("secret", 1.0, lambda: (key(), s("0123456789abcdef", r.choice([16, 20, 24, 32, 40]) + more))),
        ("secret", 1.0, lambda: (key(), s(low + up + dig, r.randint(9, 24)) + s(dig, 2))),
        ("secret", 0.0, lambda: (r.choice(lead["plain"]), s("0123456789abcdef", r.choice([10, 12, 40])))),
        ("secret", 0.0, lambda: (r.choice(lead["plain"]), s(up, 2) + sep.replace(".", "-") + s(dig, r.randint(5, 9)))),
        ("secret", 0.0, lambda: ("", s(low, r.randint(4, 9)) + s(dig, r.randint(2, 5)) + s(low, r.randint(2, 6)))),
        ("secret", 0.0, lambda: ("", s(dig, r.randint(9, 20)))),
        ("secret", 0.0, lambda: ("", words(2, "_") + "_20" + s(dig, 2) + "_" + words(1 + family, "_"))),
        ("secret", 0.0, lambda: ("", "20" + s(dig, 2) + "-0" + s("123456789", 1) + "-" + s("12", 1) + s(dig, 1))),
        ("credential", 1.0, lambda: (key(), s(low, r.randint(3, 8)) + s(dig, r.randint(1, 4)) + s(low + up, r.randint(2, 6)))),
        ("credential", 1.0, lambda: (key(), s(low + up + dig + "!$%*#", r.randint(8, 20)) + s(dig, 1))),
        ("credential", 1.0, lambda: (key(), s("0123456789abcdef", r.choice([16, 32, 40])))),
        ("credential", 0.0, lambda: (r.choice(lead["key"]), s(low, r.randint(6, 12)))),
        ("credential", 0.0, lambda: (r.choice(lead["key"]), words(2, sep))),
        ("tel", 1.0, lambda: (r.choice(lead["call"]), s(dig, 3) + r.choice(["-", ".", " "]) + s(dig, 3) + "-" + s(dig, 4))),
        ("tel", 1.0, lambda: ("", "(" + s(dig, 3) + ") " + s(dig, 3) + "-" + s(dig, 4))),
        ("tel", 0.0, lambda: (r.choice(lead["deal"]), s(dig, 3) + r.choice(["-", ".", " "]) + s(dig, 3) + r.choice(["-", " "]) + s(dig, 4))),
        ("ssn", 1.0, lambda: (r.choice(lead["id"]), s(dig, 3) + "-" + s(dig, 2) + "-" + s(dig, 4))),
        ("ssn", 0.0, lambda: (r.choice(lead["deal"]), s(dig, 3) + "-" + s(dig, 2) + "-" + s(dig, 4))),
        ("iban", 1.0, lambda: (r.choice(lead["bank"]), r.choice(["DE", "FR", "ES", "GB"]) + s(dig, 2) + " " + " ".join(s(dig, 4) for _ in range(4)) + " " + s(dig, 2))),
        ("iban", 1.0, lambda: ("", r.choice(["DE", "FR", "ES"]) + s(dig, 20))),
        ("iban", 0.0, lambda: (r.choice(lead["deal"]), s(up, 2) + s(dig, 2) + " " + s(up, 4) + " " + s(up, 4))),
        ("mail", 1.0, lambda: ("", s(low, 6 + more) + r.choice([" ", ""]) + "[at] " + s(low, 7) + " [dot] " + r.choice(["com", "org", "net"]))),
        ("mail", 0.0, lambda: ("", s(low, 2) + " (at) " + s(dig, 2) + " (dot) " + s(low, 2))),
    ]
    out = []
    for i in range(n):
        kind, label, make = makers[i % len(makers)]
        before, value = make()
        out.append((i, f"{words(6)} {before}\x01{value}\x01 {words(5)}", kind, label))
    return out


def _chances(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of labels on scores: the scores in order and their calibrated chances.

    Runs of scores whose mean would fall are pooled; one more positive and negative keep a run from certainty.
    """
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []
    for v in y[order]:
        pools.append([float(v), 1])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            total, n = pools.pop()
            pools[-1] = [pools[-1][0] + total, pools[-1][1] + n]
    chance = np.concatenate([np.full(int(n), (total + 0.5) / (n + 1)) for total, n in pools])
    return score[order], chance


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A regression tree for Newton steps: (feature, cut, left, right) or a leaf's value."""
    best = (1e-6, None)
    total = g.sum() ** 2 / (h.sum() + 1)
    if depth:
        for f in range(x.shape[1]):
            for cut in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 12), method="lower")):
                left = x[:, f] <= cut
                if 8 <= left.sum() <= len(left) - 8:
                    gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - total
                    if gain > best[0]:
                        best = (gain, (f, float(cut), left))
    if best[1] is None:
        return float(g.sum() / (h.sum() + 1))
    f, cut, left = best[1]
    return f, cut, _tree(x[left], g[left], h[left], depth - 1), _tree(x[~left], g[~left], h[~left], depth - 1)


def _value(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, cut, a, b = tree
    return np.where(x[:, f] <= cut, _value(a, x), _value(b, x))


def _sql(tree) -> str:
    if isinstance(tree, float):
        return f"{RATE * tree:.6f}D"
    f, cut, a, b = tree
    return f"IF(f.{FEATURES[f]} <= {cut:.6f}D, {_sql(a)}, {_sql(b)})"


_FITTED: dict[str, tuple[str, dict[str, float]]] = {}


def fitted(spark: SparkSession) -> tuple[str, dict[str, float]]:
    """SQL of the trees' sum over a feature struct f, and each kind's threshold on it."""
    if "pii" in _FITTED:
        return _FITTED["pii"]
    made = [(*e, family) for family in (0, 1) for e in _examples(17 + family, TRAIN_ROWS, family)]
    spots = [(i, t.replace("\x01", ""), KINDS.index(kind), t.index("\x01"), t.rindex("\x01") - 1, y, family) for i, t, kind, y, family in made]
    rows = spark.createDataFrame(spots, "i int, t string, k int, s int, e int, y double, family int")
    rows = rows.selectExpr("family", "i", "y", "k", "t", "named_struct('k', k, 's', s, 'e', e, 'm', substring(t, s + 1, e - s)) AS x").selectExpr("family", "i", "y", "k", f"{_features()} AS f")
    got = sorted(rows.selectExpr("family", "i", "y", "k", "f.*").collect())  # 2 * TRAIN_ROWS rows
    y = np.array([r.y for r in got])
    x = np.array([[r[c] for c in FEATURES] for r in got])
    kinds, fit = np.array([r.k for r in got]), np.array([r.family == 0 for r in got])
    score, trees = np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        trees.append(_tree(x[fit], (y - p)[fit], (p * (1 - p))[fit], 3))
        score += RATE * _value(trees[-1], x)
    cuts = {}
    for k, kind in enumerate(KINDS):
        mine = ~fit & (kinds == k)
        if mine.any():
            at, chance = _chances(score[mine], y[mine])
            good = np.flatnonzero(chance >= PRECISION)
            # half way to the score below, which nothing between the two speaks for or against
            cuts[kind] = float(at[good[0]] + at[max(good[0] - 1, 0)]) / 2 - 1e-6 if len(good) else 1e9
    _FITTED["pii"] = " + ".join(_sql(t) for t in trees), cuts
    return _FITTED["pii"]


def find(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Rows (doc_id, base, spans), one per input row: arrays of (start, end, kind) by start and kind.

    ``base`` holds email, ip, card and phone; ``spans`` those and the selected further kinds.  A null
    text is empty.  Every row is judged by itself, so null and repeated ids are carried; other
    columns are ignored.  ``keep_text`` adds the text as t.
    """
    t = ["t"] if keep_text else []
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    rows = rows.withColumn("d", F.col("t").rlike("[0-9]"))
    needs = {k: F.col("t").contains(n) if n else F.col("d") for k, (_, n) in BASE.items()}
    needs |= {"secret": F.col("d"), "tel": F.col("d"), "ssn": F.col("d") & F.col("t").contains("-"), "iban": F.col("d"), "credential": F.col("t").rlike(NAMED), "mail": F.col("t").rlike(r"[\[(]at[\])]")}
    rows = _generated(rows, {k: ((BASE[k][0] if k in BASE else MORE[k]), needs[k]) for k in KINDS}, ["doc_id", "t"])
    base = [f"transform(filter(k_{k}, x -> {CHECKS[k]}), x -> named_struct('s', x.s, 'k', {i}, 'e', x.e))" for i, k in enumerate(BASE)]
    more = [f"transform(k_{k}, x -> named_struct('s', x.s, 'e', x.e, 'm', x.m, 'k', {i + len(BASE)}))" for i, k in enumerate(MORE)]
    rows = rows.select("doc_id", "t", F.expr(f"array_sort(concat({', '.join(base)}))").alias("b"), F.expr(f"concat({', '.join(more)})").alias("c"))
    # proposals that touch a base span are its own or a part of it
    rows = rows.select("doc_id", "t", "b", F.expr("filter(c, x -> NOT exists(b, y -> x.s < y.e AND y.s < x.e))").alias("c"))
    model, cuts = fitted(docs.sparkSession)
    rows = rows.select("doc_id", *t, "b", F.expr(f"transform(c, x -> named_struct('x', named_struct('s', x.s, 'e', x.e, 'k', x.k), 'f', {_features()}))").alias("c"))
    rows = rows.select("doc_id", *t, "b", F.expr(f"transform(c, z -> named_struct('v', aggregate(array(z.f), 0.0D, (a, f) -> a + {model}), 's', z.x.s, 'e', z.x.e, 'k', z.x.k))").alias("c"))
    passes = " OR ".join(f"(x.k = {KINDS.index(k)} AND x.v >= {v:.6f}D)" for k, v in cuts.items())
    rows = rows.select("doc_id", *t, "b", F.expr(f"filter(c, x -> {passes})").alias("c"))
    best = "filter(c, x -> NOT exists(c, y -> x.s < y.e AND y.s < x.e AND (y.v, -y.s, -y.k) > (x.v, -x.s, -x.k)))"
    rows = rows.select("doc_id", *t, "b", F.expr(f"array_sort(concat(b, transform({best}, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e))))").alias("a"))
    names = ", ".join(f"'{k}'" for k in KINDS)
    as_spans = "transform({0}, x -> named_struct('start', x.s, 'end', x.e, 'kind', element_at(array(" + names + "), x.k + 1)))"
    return rows.select("doc_id", *t, F.expr(as_spans.format("b")).alias("base"), F.expr(as_spans.format("a")).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (doc_id, redacted), one per input row: spans replaced by their kind in brackets.

    Overlapping base spans are replaced together under the first one's kind.
    """
    fold = (
        "aggregate(spans, named_struct('p', 0, 'o', ''), (a, x) -> IF(x.start < a.p, named_struct('p', greatest(a.p, x.`end`), 'o', a.o), "
        "named_struct('p', x.`end`, 'o', concat(a.o, substring(t, a.p + 1, x.start - a.p), '[', x.kind, ']'))), a -> concat(a.o, substring(t, a.p + 1)))"
    )
    return find(docs, text, keep_text=True).select("doc_id", F.expr(fold).alias("redacted"))


def report(docs: DataFrame, text: str = "text") -> DataFrame:
    """``find`` as counts, the hash of the base spans, and all spans as text."""

    def joined(c: str) -> Column:
        return F.array_join(F.expr(f"transform({c}, x -> concat(x.kind, ':', x.start, ':', x.`end`))"), ",")

    counts = [F.expr(f"size(filter(base, x -> x.kind = '{k}'))").cast("bigint").alias(f"n_{k}") for k in BASE]
    return find(docs, text).select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
