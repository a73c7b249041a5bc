"""The operators beyond SQL against plain definitions, and figures of what the models find."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from octolith.llm import fingerprint, langid, linededup, packing, pii, simhash

SF = "/root/testdata/sf0.01"


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n))


# language ---------------------------------------------------------------------------------------------


def test_kneser_ney_by_its_definition():
    """Interpolated Kneser-Ney with dictionaries, for every 4-gram of a stream and for unseen ones."""
    rng = np.random.default_rng(1)
    streams = [np.array([1, 1, 1, *rng.integers(1, 7, 300)]) for _ in range(3)]
    model = langid.KneserNey.fit(streams)
    grams = Counter(tuple(s[k : k + 4].tolist()) for s in streams for k in range(len(s) - 3))
    counts = {4: grams}
    for order in (3, 2, 1):  # distinct left neighbours
        counts[order] = Counter(g[1:] for g in counts[order + 1])
    discount = {}
    for order, c in counts.items():
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discount[order] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    def prob(gram):
        order = len(gram)
        if not order:
            return 1 / (1 << langid.SYMBOL_BITS)
        same = {g: c for g, c in counts[order].items() if g[:-1] == gram[:-1]}
        lower = prob(gram[1:])
        if not same:
            return lower
        total = sum(same.values())
        return max(same.get(gram, 0) - discount[order], 0) / total + discount[order] * len(same) / total * lower

    some = [*list(grams)[:150], *(tuple(rng.integers(1, 12, 4).tolist()) for _ in range(150))]
    codes = np.array([sum(x << (langid.SYMBOL_BITS * (3 - k)) for k, x in enumerate(g)) for g in some], dtype=np.uint64)
    assert np.allclose(np.exp(model.log_prob(codes)), [prob(g) for g in some], rtol=1e-9)


def test_rejection_and_held_out_accuracy(spark):
    """Documents of a language that was not learnt are rejected, others are not; those never learnt from are told right."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    docs = docs.withColumn("held_out", langid.held_out()).repartition(8).cache()
    model = langid.fit(langid.labelled_sample(docs))
    got = langid.identify(docs, model).filter("held_out").select("lang", "lang_pred", "rejected").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.99 * len(got) and sum(r.rejected for r in got) <= 0.002 * len(got)
    for unknown in ("en", "fr"):
        model = langid.fit(langid.labelled_sample(docs.filter(f"lang <> '{unknown}'")))
        got = langid.identify(docs, model).select("lang", "rejected").collect()
        foreign, known = [r.rejected for r in got if r.lang == unknown], [r.rejected for r in got if r.lang != unknown]
        assert sum(foreign) >= 0.9 * len(foreign) and sum(known) <= 0.005 * len(known), unknown


def test_language_of_equal_models_and_long_rows(spark):
    """Of languages alike the first by name wins; repeated rows agree; a very long text and extra columns pass; names of the result are replaced."""
    rng = random.Random(2)
    made = [(k, words(rng, 40), "bb" if k % 2 else "aa", "x", 5) for k in range(40)]
    made = [(k, t, lang, s, n) for k, t, _, s, n in made for lang in ("aa", "bb")]  # the same texts for both
    made += [(100, words(rng, 60_000), None, "x", 5)] * 2
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, rejected string, score int")
    got = langid.identify(docs, langid.fit(langid.labelled_sample(docs))).collect()
    assert {r.lang_pred for r in got} == {"aa"} and len(got) == len(made)
    assert len({(r.lang_pred, r.score, r.cross_entropy) for r in got if r.doc_id == 100}) == 1
    assert all(isinstance(r.rejected, bool) and 0 <= r.score <= 1 for r in got)


# lines ------------------------------------------------------------------------------------------------


def expected_drops(docs):
    """By the rules, for lines of which no two share their leading tokens unless they are equal up to numbers."""
    parsed, groups = {}, defaultdict(dict)
    for key, text in docs.items():
        for pos, line in enumerate((text or "").split("\n")):
            t = line.split(" ")
            t = [x for x in t if x]
            if not t:
                continue
            masked = ["<*>" if re.search("[0-9]", x) else x for x in t]
            names = [("equal", tuple(t), linededup.EXACT_DOCS if len(t) >= 3 else linededup.SHORT_DOCS)]
            if len(t) >= 3 and masked != t:
                names.append(("template", tuple(masked), linededup.MIN_DOCS))
            parsed[key, pos] = names
            for n in names:
                groups[n][key] = True
    first = {n: min(keys) for n, keys in groups.items() if len(keys) >= n[2]}
    drops = defaultdict(list)
    for (key, pos), names in sorted(parsed.items()):
        if any(n in first and first[n] != key for n in names):
            drops[key].append(pos)
    return drops


def test_lines_by_brute_force(spark):
    rng = random.Random(8)
    base = [f"lead{k} " + words(rng, rng.randint(1, 14)) for k in range(60)] + [f"s{k}" for k in range(10)] + ["", " \t "]
    numbered = {k for k in range(60) if k % 3 == 0}

    def line():
        k = rng.randrange(len(base))
        tail = f" {rng.randint(1, 4)} end" if k in numbered else ""
        return base[k].replace(" ", rng.choice([" ", "  ", "\t"]), 1) + tail + rng.choice(["", " "])

    docs = {k: "\n".join(line() for _ in range(rng.randint(0, 8))) for k in range(60)}
    docs[60], docs[61], docs[62] = docs[3], None, ""
    rows = [*docs.items(), (5, docs[5])]  # a repeated row counts once
    got = linededup.line_report(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, drops int").repartition(3)).collect()
    want = expected_drops({k: (t or "").replace("\t", " ") if t is not None else None for k, t in docs.items()})
    assert len(got) == len(rows)
    for r in got:
        assert r.dropped == ",".join(map(str, want.get(r.doc_id, []))), (r.doc_id, docs[r.doc_id])
        stay = "\n".join(x for n, x in enumerate((docs[r.doc_id] or "").split("\n")) if n not in want.get(r.doc_id, []))
        assert r.text_sha256 == hashlib.sha256(stay.encode()).hexdigest()


def test_recall_of_templates(spark):
    """Templates with one or two free words, several in a leaf, beside lines that recur nowhere: most of their lines go, and few of the others."""
    rng = random.Random(12)
    forms = [words(rng, 12).split() for _ in range(12)]
    for k, f in enumerate(forms):
        f[:3] = ["the", "common", f"start{k // 4}"]  # four templates share each leaf
    docs, planted, other = [], 0, 0
    for d in range(300):
        lines = []
        for _ in range(4):
            if rng.random() < 0.6:
                f = list(rng.choice(forms))
                for place in rng.sample(range(3, 12), rng.choice([1, 2])):
                    f[place] = words(rng, 1, "uvwxyz")
                lines.append(" ".join(f))
            else:
                lines.append(f"the common start{rng.randrange(3)} " + words(rng, 9, "klmnopqrst"))
        docs.append((d, "\n".join(lines)))
    got = linededup.line_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    hit = miss = wrong = 0
    for r in got:
        gone = set(map(int, filter(None, r.dropped.split(","))))
        for n, line in enumerate(docs[r.doc_id][1].split("\n")):
            common = any(sum(a == b for a, b in zip(line.split(), f, strict=True)) >= 9 for f in forms)
            hit, miss, wrong = hit + (common and n in gone), miss + (common and n not in gone), wrong + (not common and n in gone)
    assert hit >= 0.9 * (hit + miss), (hit, miss)
    assert wrong <= 0.01 * len(docs) * 4, wrong


# fingerprints -----------------------------------------------------------------------------------------


def test_polynomial_hashes_by_their_definition():
    powers, rng = fingerprint.Powers(), random.Random(3)
    for text in ["", "a", "äöü😀" * 9, words(rng, 200)]:
        p = fingerprint.PrefixHash(text, powers)
        for _ in range(20):
            i = rng.randint(0, len(text))
            j = rng.randint(i, len(text))
            want = [sum((ord(c) + 1) * pow(b, k, m) for k, c in enumerate(text[i:j])) % m for m, b in zip(fingerprint.MODULI, fingerprint.BASES, strict=True)]
            assert p.span(i, j) == want[0] << 31 | want[1]


def test_likeness_follows_the_share_kept():
    """A text whose first part is kept is as like as that share, within a rung of the ladder; its spans are the other half of the measure."""
    powers, rng = fingerprint.Powers(), random.Random(4)
    for _ in range(60):
        text, other = words(rng, rng.randint(30, 400)), words(rng, 400)
        keep = rng.uniform(0.3, 0.95)
        cut = int(len(text) * keep)
        new = text[:cut] + other[: len(text) - cut]
        like = fingerprint.likeness(fingerprint.fingerprint(text, powers), fingerprint.fingerprint(new, powers))
        assert keep * 0.9 - 0.02 <= like <= 1


# packing ----------------------------------------------------------------------------------------------


def test_pieces_by_the_tokenizer(spark):
    """Every piece's start, length and checksum from the tokenizer's ids of the whole text; places are gapless."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").filter("doc_id % 7 = 0")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = packing.pack(docs, packing.default_tokenizer(), 512).collect()
    tokenizer = packing.Encoder(packing.default_tokenizer()).tokenizer
    want = {}
    for k, t in texts.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, packing.END_ID]
        for n, at in enumerate(range(0, len(ids), 512)):
            part = np.array(ids[at : at + 512], dtype="<u4")
            want[k, n] = (at, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    assert len(bins) <= 1.05 * -(-sum(r.length for r in got) // 512) + 1


def test_bins_against_first_fit_decreasing():
    rng = random.Random(7)
    for _ in range(40):
        lengths = [min(100, max(1, int(rng.lognormvariate(3, 0.9)))) for _ in range(rng.randint(1, 300))]
        used = sum(times for _, times in packing.plan_bins(dict(Counter(lengths)), 100))
        bins = []
        for n in sorted(lengths, reverse=True):
            k = next((k for k, room in enumerate(bins) if room >= n), None)
            if k is None:
                bins.append(100 - n)
            else:
                bins[k] -= n
        assert -(-sum(lengths) // 100) <= used <= len(bins) * 1.02 + 1


# near-duplicates --------------------------------------------------------------------------------------


def test_simhash_bit_by_bit():
    rng = random.Random(9)
    for text in ["", "one", "Two words", "A B c", *(words(rng, rng.randint(3, 80)) + rng.choice(["", "\x0b tab\tÄ"]) for _ in range(30))]:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)] * bool(w)
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
        assert simhash.simhash(text.encode(), 3) == want


@pytest.mark.parametrize("spread", [2, 64])
def test_forest_against_all_pairs(spread):
    """The same components as from all pairs, in dense groups (whose subtrees are skipped) and sparse ones."""
    rng = np.random.default_rng(spread)
    start = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fp = np.repeat(start, 200)
    for _ in range(3):
        fp = fp ^ (np.uint64(1) << rng.integers(0, spread, len(fp)).astype(np.uint64))
    fp = np.unique(fp)
    rng.shuffle(fp)
    n = len(fp)
    x, y = np.triu_indices(n, 1)
    near = np.bitwise_count(fp[x] ^ fp[y]) <= 2
    want = simhash._merged(np.arange(n), x[near], y[near])
    rows, roots = simhash.forest_links(np.zeros(n, dtype=np.int64), fp, 2)
    got = np.arange(n)
    got[rows] = roots
    assert np.array_equal(got, want)


def test_large_shards_are_dealt(spark, monkeypatch):
    """Shards cut into pairs of blocks give the same components: no link between blocks is lost."""
    rng = np.random.default_rng(23)
    start = rng.integers(0, 2**62, 4, dtype=np.uint64)
    fp = np.repeat(start, 300)
    for _ in range(3):
        fp = fp ^ (np.uint64(1) << rng.integers(0, 62, len(fp)).astype(np.uint64))
    rows = spark.createDataFrame([(int(x),) for x in np.unique(fp).view(np.int64)], "fp long").repartition(4)
    want = sorted(map(tuple, simhash.connected_components(simhash.hamming_links(rows)).collect()))
    monkeypatch.setattr(simhash, "WHOLE_SHARD", 8)
    monkeypatch.setattr(simhash, "BLOCK_ROOTS", 2)
    assert sorted(map(tuple, simhash.connected_components(simhash.hamming_links(rows)).collect())) == want and len(want) > 100


# personal data ----------------------------------------------------------------------------------------


def test_recall_of_private_spans(spark):
    """Planted identifiers of several shapes, in prose: most are found, and few other tokens with digits."""
    rng = random.Random(14)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 1)) + "7f"
    shapes = [lambda: f'token = "{hexa(39)}"', lambda: f"password: {words(rng, 1, 'qwertzui')}-{hexa(12)}", lambda: f"iban: DE{rng.randrange(10**20):020d}", lambda: f"ssn: {rng.randrange(100, 999)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}", lambda: f"apikey={''.join(rng.choice('ABCDEFabcdef0123456789XYZxyz') for _ in range(32))}"]
    plain = [lambda: f"page {rng.randrange(10**7)}", lambda: f"about {rng.randrange(10**6, 10**7)} km", lambda: f"version {rng.randrange(99)}.{rng.randrange(99)}.{rng.randrange(99)}-{rng.randrange(10)}", lambda: f"({words(rng, 1)}-{rng.randrange(1990, 2030)})"]
    made, planted = [], set()
    for k in range(600):
        t = words(rng, 12, "abcdefghijklmn")
        if k % 3 == 0:
            t += " " + rng.choice(shapes)()
            planted.add(k)
        elif k % 3 == 1:
            t += " " + rng.choice(plain)()
        made.append((k, t + " " + words(rng, 5)))
    got = {r.doc_id: r.n_private for r in pii.find_spans(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    found = {k for k, n in got.items() if n}
    assert len(found & planted) >= 0.9 * len(planted), len(found & planted) / len(planted)
    assert len(found - planted) <= 0.02 * (len(made) - len(planted))


def test_expectation_maximisation_finds_the_reliable_labeler():
    """Simulated votes: the posterior follows the labelers that are right, not the one that votes at random."""
    rng = random.Random(15)
    patterns, truth = Counter(), defaultdict(list)
    for _ in range(20_000):
        y = rng.random() < 0.3
        vote = lambda right: (1 if y else -1) if rng.random() < right else rng.choice([1, 0, -1])  # noqa: B023, E731
        v = (vote(0.8), vote(0.7), vote(0.6), rng.choice([1, 0, -1]))
        patterns[v] += 1
        truth[v].append(y)
    post = pii.expectation_maximisation(dict(patterns))
    error = sum(abs(post[v] - sum(ys) / len(ys)) * len(ys) for v, ys in truth.items()) / 20_000
    assert error < 0.05, error


def test_many_matches_and_extra_columns(spark):
    """A text of very many matches, repeated rows and columns that clash."""
    text = "x " + " ".join(f"10.{k % 250}.{k // 250}.7 tok{k}en99" for k in range(3000))
    rows = [(1, text, "a", "b"), (1, text, "a", "b"), (2, None, None, None)]
    got = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string, t string, card string")).collect()
    assert [r.n_ip for r in got if r.doc_id == 1] == [3000, 3000]
    want = ",".join(f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", text))
    assert {r.base_sha256 for r in got if r.doc_id == 1} == {hashlib.sha256(want.encode()).hexdigest()}
