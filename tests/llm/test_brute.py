"""Operators against plain Python on small tables, and kernels against their libraries."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from voxloom.llm import bpe, kneser, lines, packing, pii, quality, setsketch
from voxloom.llm.kernel import shingle_sets, texts_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def near_copies(n: int, seed: int) -> list[tuple[int, str]]:
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefgéß", k=r.randint(1, 6))) for _ in range(400)]
    base = [r.choices(vocab, k=r.randint(3, 90)) for _ in range(n // 4)]
    out = []
    for i in range(n):
        words = list(base[i % len(base)])
        for _ in range(r.randint(0, max(1, len(words) // 9))):
            words[r.randrange(len(words))] = r.choice(vocab).upper()
        out.append((i, r.choice([" ", "\n"]).join(words)))
    return out


def united(n: int, links) -> list[int]:
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_near_duplicates(spark):
    rows = near_copies(160, 3)
    low = [WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t)) for _, t in rows]
    sets = [set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} for w in low]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = {i: (len(sets[i]), c) for i, c in enumerate(united(len(rows), links))}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), width=2).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(rows)


def test_sketch_estimates():
    import pyarrow as pa

    r = random.Random(1)
    text = [" ".join(str(r.random()) for _ in range(400)) for _ in range(2)]
    mixed = text[0].split()[:300] + text[1].split()[:100]
    h, b = shingle_sets(texts_of(pa.array([text[0], " ".join(mixed)])), 1)
    regs = setsketch.registers(h, b, 4096)
    a, c = set(h[b[0] : b[1]]), set(h[b[1] : b[2]])
    true = len(a & c) / len(a | c)
    got = setsketch.joint_jaccard(regs[:1], regs[1:], np.array([len(a)]), np.array([len(c)]))[0]
    assert abs(got - true) < 0.05
    union = np.unique(h)
    assert (setsketch.registers(union, np.array([0, len(union)]), 4096)[0] == setsketch.merge(regs[0], regs[1])).mean() > 0.999


def test_line_dedup(spark):
    r = random.Random(5)
    rows = [(i, "\n".join(["Short", t.replace("\n", " "), "x" * r.randint(0, 30)])) for i, t in near_copies(60, 8)]
    seen = {}
    for i, t in rows:
        for k, line in enumerate(t.split("\n")):
            line = line.strip(" ").lower()
            if len(line) >= lines.MIN_CHARS:
                seen.setdefault(line, []).append((i, k))
    keys = list(seen)
    every = [{k[i : i + 12] for i in range(max(1, len(k) - 11))} for k in keys]
    links = [(a, b) for a in range(len(keys)) for b in range(a) if 100 * len(every[a] & every[b]) >= 80 * len(every[a] | every[b])]
    want = defaultdict(list)
    groups = defaultdict(list)
    for i, c in enumerate(united(len(keys), links)):
        groups[c] += seen[keys[i]]
    for g in groups.values():
        for at in sorted(g)[1:]:
            if at != min(g):
                want[at[0]].append(at[1])
    got = {x.doc_id: list(x.gone) for x in lines.duplicate_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {k: sorted(v) for k, v in want.items()}


def test_long_lines_are_compared_on_all_shingles(spark):
    r = random.Random(11)

    def edited(line, n):
        chars = list(line)
        for at in range(5, 5 + n * 14, 14):
            chars[at] = "Q"
        return "".join(chars)

    letters = "".join(r.choices("bcdfghkmnp", k=400))
    # words stay, so that shingles after spaces agree, and what lies inside the long tokens differs
    tokens = ["".join(r.choices("bcdfghkmnp", k=60)) for _ in range(8)]
    lines_of = [letters, edited(letters, 2), " ".join(tokens), " ".join(t[:13] + t[:12:-1] for t in tokens)]
    shingles = [{x.lower()[i : i + 12] for i in range(len(x) - 11)} for x in lines_of]
    near = [[100 * len(a & b) >= 80 * len(a | b) for b in shingles] for a in shingles]
    assert near[0][1] and not near[2][3]
    got = {x.doc_id: list(x.gone) for x in lines.duplicate_lines(spark.createDataFrame(list(enumerate(lines_of)), "doc_id bigint, text string")).collect()}
    assert got == {1: [0]}


def test_lines_that_share_only_their_beginning_stay(spark):
    a = "-----BEGIN-abcdefghijklmnopqrstuvwxyz" + "".join(random.Random(1).choices("abcdefghijklm", k=104))
    b = "-----BEGIN-a" + "".join(random.Random(2).choices("nopqrstuvwxyz", k=128))
    rows = [(1, a), (2, b), (3, "=" * 150), (4, "=" * 149), (5, "=" * 60 + "-" * 60), (None, a)]
    got = {x.doc_id: list(x.gone) for x in lines.duplicate_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {4: [0]}


def test_signature_recall_at_the_threshold(spark):
    """Pairs at similarity 0.8 and more, long and short: bands and agreement miss at most 3 in 100."""
    r = random.Random(13)
    rows, pairs = [], 0
    for k in range(600):
        n = r.choice([24, 40, 80, 300])
        line = "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=n)).strip().ljust(n, "x")
        other = list(line)
        edits = 1 if n < 300 else 2
        for e in range(edits):
            other[-1 - e] = "Q"
        x, y = ({t[i : i + 12] for i in range(len(t) - 11)} for t in (line, "".join(other).lower()))
        if 100 * len(x & y) >= 80 * len(x | y):
            pairs += 1
            rows += [(2 * k, line), (2 * k + 1, "".join(other))]
    got = sum(len(x.gone) for x in lines.duplicate_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert pairs > 300 and pairs * 0.97 <= got <= pairs


def test_tokens_equal_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.default_path()
    t = tokenizers.Tokenizer.from_file(path)
    r = random.Random(2)
    odd = [chr(c) for c in [*range(700), 0x1680, 0x2003, 0x2028, 0x3000, 0x4E00, 0x1F600, 0x661, 0x2160, 0x300, 0x10D40, 0x1E5D0, 0x200B, 0xFEFF]]
    texts = ["".join(r.choices(odd, k=r.randint(0, 50))) for _ in range(800)] + ["".join(r.choices(" 'strevmld\n\tABz09!?", k=r.randint(0, 60))) for _ in range(800)]
    texts += [None, "", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "a" * 500, " " * 40, "it's  we'll\n\n x"]
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert bpe.counts_of(texts, path).tolist() == [len(w) for w in want]
    assert [x.tolist() for x in packing.ids_of(texts, path)] == [[*w, 1] for w in want]


def test_first_fit_decreasing():
    r = random.Random(4)
    sizes = np.array([r.randint(1, 100) for _ in range(300)])
    bins, offset = packing.first_fit_decreasing(sizes, 100)
    room: list[int] = []
    for i in sorted(range(300), key=lambda i: -sizes[i]):
        at = next((k for k, free in enumerate(room) if free >= sizes[i]), len(room))
        if at == len(room):
            room.append(100)
        assert (bins[i], offset[i]) == (at, 100 - room[at])
        room[at] -= sizes[i]


def test_quality_base(spark):
    rows = near_copies(40, 6) + [(100, "a b c a b c a b c\n# $x\nz\nz\n\n \nz"), (101, "é😀 |<>| x")]
    rows = [(i, t + "\n" + t.split("\n")[0]) for i, t in rows]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id bigint, text string, lang string")).collect()}
    for i, t in rows:
        w = WORD.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
        g = got[i]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit))
        assert g.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and (not g.base_failed or not g.kept)


def test_quality_distance_fails_odd_documents(spark):
    """Documents of an odd character mix, or without a language's common words, fail on distance; few documents judge none."""
    r = random.Random(4)
    common = quality.COMMON["en"]

    def text(odd):
        ws = ["".join(r.choices("xqzjkvw" if odd else "abcdefghilmnoprstu", k=r.randint(3, 9))) for _ in range(160)]
        return " ".join(w.upper() + str(r.randint(0, 999999)) if odd else r.choice(common) if r.random() < 0.4 else w for w in ws)

    rows = [(k, text(k == 0), "en") for k in range(60)] + [(k, text(True), "xx") for k in range(60, 65)]
    got = {x.doc_id: x for x in quality.quality(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert not got[0].base_failed and not got[0].kept and all(got[k].kept for k in range(1, 65))
    assert got[0].js_chars + got[0].js_words > max(got[k].js_chars + got[k].js_words for k in range(1, 60))
    assert all(got[k].js_chars is None for k in range(60, 65))


def test_kneser_counts_over_32_bits():
    counts = np.array([1, 3, 1 << 40, 7], np.int64)
    keys = np.array([5, 9, 1 << 63, (1 << 63) + 4], np.uint64)
    k, c = kneser.unpack(kneser.pack(keys, counts), 1)
    assert (k == keys).all() and (c == counts).all()
    assert kneser.narrow(counts).dtype == np.uint64 and kneser.narrow(counts[:2]).dtype == np.uint32


def test_kneser_ney(spark):
    rows = [(i, t + " the end of it") for i, t in near_copies(120, 9)]
    got = {r.doc_id: r for r in kneser.score(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    texts = {i: [*WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t)), "</s>"] for i, t in rows}
    c, b = Counter(), Counter()
    for i, w in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            c.update(w)
            b.update(zip(["<s>", *w], w, strict=False))
    n, v = sum(c.values()), len(c)
    ctx, cont = defaultdict(lambda: [0, 0, 0, 0]), Counter()
    for (p, w), k in b.items():
        ctx[p][0] += k
        ctx[p][min(k, 3)] += 1
        cont[w] += 1
    d2, d1 = (kneser.discounts([Counter(x.values())[k] for k in (1, 2, 3, 4)]) for x in (b, cont))
    total = sum(cont.values())
    spare = sum(d1[min(x, 3) - 1] for x in cont.values()) / total

    def prob(p, w):
        low = (cont[w] - (d1[min(cont[w], 3) - 1] if cont[w] else 0)) / total + spare / (v + 1)
        if p not in ctx:
            return low
        x, k = ctx[p], b[p, w]
        return (k - (d2[min(k, 3) - 1] if k else 0)) / x[0] + (d2[0] * x[1] + d2[1] * x[2] + d2[2] * x[3]) / x[0] * low

    assert abs(sum(prob("the", w) for w in c) + prob("the", "\x00") - 1) < 1e-9
    for i, w in texts.items():
        g = got[i]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(w), sum(x in c for x in w), n)
        assert g.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), abs=1e-6)
        assert g.score == pytest.approx(sum(math.log10(prob(p, x)) for p, x in zip(["<s>", *w], w, strict=False)), abs=1e-6)


def test_pii_base_and_redaction(spark):
    rows = [(1, "a@b.c%d@e.f x@y..z 1.2.3.4.5.6.7.8 300.1.1.1 00255.0.0.1 +1 (22) 333-44-55 é 4111 1111 1111 1111-4"), (2, "4111-1111-1111-1111"), (3, "a.b@c" + ".d" * 20000), (4, "😀 token = 'f33e61083db5dbdf4bd2369d2f80176e57f7fda2'")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.report(d).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (2, 3, 0, 1)
    assert got[2].spans == "card:0:19" and got[3].spans == f"email:0:{5 + 40000}"
    assert {r.doc_id: r.redacted for r in pii.redact(d).collect()}[4] in ("😀 token = '[secret]'", "😀 token = '[credential]'")


def _plain_pii(text: str) -> list[tuple[int, int, str]]:
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def test_pii_base_equals_the_patterns_on_random_texts(spark):
    r = random.Random(21)
    bits = ["a.b", "@", "c-d", ".e", "1.2", ".300", ".4", ".55", " 4111 1111 1111 1111", "-", "+1", " (22)", "333", " ", "é", "😀", "\n", "%", "0000", "9"]
    rows = [(k, "".join(r.choices(bits, k=r.randint(0, 14)))) for k in range(3000)]
    got = {x.doc_id: [(s.start, pii.KINDS.index(s.kind), s.end) for s in x.base] for x in pii.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[k] == _plain_pii(t) for k, t in rows)


def test_pii_recall_and_precision_on_other_generators(spark):
    """Texts from contexts and shapes that neither trained nor calibrated the trees."""
    made = pii._examples(99, 2000, 2)
    rows = [(i, t.replace("\x01", "")) for i, t, _, _ in made]
    got = {x.doc_id: [(s.start, s.end) for s in x.spans] for x in pii.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    hit = {i: any(a < t.rindex("\x01") - 1 and b > t.index("\x01") for a, b in got[i]) for i, t, _, _ in made}
    right = sum(hit[i] for i, _, _, y in made if y)
    recall, precision = right / sum(y for *_, y in made), right / max(1, sum(hit.values()))
    assert recall >= 0.85 and precision >= 0.85, (recall, precision)
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame([(1, "password: hunter2abc99"), (2, "see file_2024_report_final there")], "doc_id bigint, text string")).collect()}
    assert got[1] == "credential:10:22" and got[2] == ""


def test_line_sketches_lose_no_link_and_rule_most_others_out(spark):
    """Before sets are made: every linked pair fits, with repeated shingles and wide characters too; at 0.3 to 0.7 few do."""
    from pyspark.sql import functions as F

    r = random.Random(17)
    rows = []
    for k in range(300):
        n = r.choice([20, 60, 330, 700])
        line = ("=" * n if k % 10 == 0 else "".join(r.choices("abcdefgéß語 ", k=n)).strip().ljust(n, "x"))
        cut = int(n * r.uniform(0, 0.5))
        rows.append((k, line, line[: n - cut] + "".join(r.choices("mnopqrst", k=cut)) if k % 2 else line + "q" * (cut // 3)))
    shingles = lambda t: {t[i : i + 12] for i in range(max(1, len(t) - 11))}
    alike = {k: len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for k, a, b in rows}
    both = []
    for x in (1, 2):
        d = spark.createDataFrame([(row[0], row[x]) for row in rows], "id bigint, line string")
        d = d.select(F.struct(F.col("id").alias("doc_id"), F.lit(0).alias("no")).alias("at"), F.struct(*[F.lit(0).alias(f"m{m}") for m in range(lines.MINS)]).alias("m"), "line")
        both.append(lines._sketched(d).select(F.col("at.doc_id").alias("id"), F.col("m").alias(f"m{x}")))
    fit = {row.id for row in both[0].join(both[1], "id").where(lines._fits("m1", "m2", 80)).collect()}
    linked, apart = {k for k, s in alike.items() if s >= 0.8}, {k for k, s in alike.items() if 0.3 < s < 0.7}
    assert linked <= fit and len(linked) > 50 and len(apart) > 30 and len(apart & fit) < 0.2 * len(apart)


def test_pairs_of_a_group_below_the_similarity_make_no_rows(spark, monkeypatch):
    """150 lines, each pair at 0.789 and likely by signature and sketch: tables grow with lines, not with pairs."""
    r = random.Random(19)
    line = "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=113))
    rows = [(i, line[:50] + chr(0x4E00 + i) + line[51:]) for i in range(150)]
    made = {}

    def counted(df, name, *args, **options):
        out = write_table(df, name, *args, **options)
        made[name] = out.count()
        return out

    write_table = lines.write_table
    monkeypatch.setattr(lines, "write_table", counted)
    assert lines.duplicate_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).count() == 0
    assert made["line-buckets"] >= 150 and max(made.values()) <= 20 * len(rows), made


def test_blocks_join_what_a_pivot_left_apart_with_few_links(spark):
    """A bucket none of whose lines is linked yet: clusters come together by fewer links than lines, others stay."""
    r = random.Random(23)
    text, cluster = [], []
    for c in range(14):
        base = "".join(r.choices("abcdefghijklmnop é語", k=r.choice([60, 300]))).strip().ljust(50, "x")
        for _ in range(r.choice([1, 6, 12])):
            text.append(base + chr(0x5000 + len(text)))
            cluster.append(c)
    found = spark.createDataFrame(list(enumerate(text)), "at bigint, line string")
    signed = lines.signatures(found.selectExpr("at", "xxhash64(line) AS h1", "xxhash64(1, line) AS h2", "line"))
    texts = found.join(signed.selectExpr("at", "struct(" + ", ".join(f"m{k}" for k in range(lines.MINS)) + ") AS m"), "at").selectExpr("at", "m", "line", "char_length(line) AS wide")
    links = lines._across(found.selectExpr("7L AS key", "at"), spark.createDataFrame([], "id bigint, component bigint"), texts, 80).collect()
    firsts = {}
    for i, c in enumerate(cluster):
        firsts.setdefault(c, i)
    together = united(len(text), [(x.a, x.b) for x in links])
    assert len({(together[i], cluster[i]) for i in range(len(text))}) == len(set(together)) == len(firsts)
    assert 60 < len(text) < lines.BLOCK and len(links) == len(text) - len(firsts)


def test_line_dedup_with_ids_far_apart(spark):
    line = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(1 << 62, f"{line}\n{line}!"), (-(1 << 61), f"short\n{line}\nnothing else is like this line at all"), (5, line), (None, line)]
    got = {x.doc_id: list(x.gone) for x in lines.duplicate_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1 << 62: [0, 1], 5: [0]}
    near = {x.doc_id: list(x.gone) for x in lines.duplicate_lines(spark.createDataFrame([(i, t) for i, t in zip((-7, -3, 4), (line, "short", line), strict=True)], "doc_id int, text string")).collect()}
    assert near == {4: [0]}
    none = lines.duplicate_lines(spark.createDataFrame([(None, line)], "doc_id bigint, text string"))
    assert none.count() == 0 and dict(none.dtypes) == {"doc_id": "bigint", "gone": "array<int>"}
