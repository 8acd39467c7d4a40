"""Every operator against a plain version of its contract, on a corpus with all odd cases."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def key(doc_id):
    return -(1 << 63) if doc_id is None else doc_id


def levenshtein_at_most_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def test_line_dedup(spark):
    from sagebrush.llm.line_dedup import dedup_lines

    base = "the quick brown fox jumps over it"
    texts = {1: f"{base}\nshort\nanother line that is long enough", 2: f"{base[:10]}X{base[11:]}\nshort", 3: f"{base[:5]}{base[6:]}\n\n{base}",
             4: f"{base[:10]}Y{base[11:]}zz\n{base.upper()}  ", 5: None, 6: "", 7: "aaaaaaaaaaaaaaaaaaaaaaaaa\naaaaaaaaaaaaaaaaaaaaaaaa\naaaaaaaaaaaaaaaaaaaaaab",
             8: "transposed liens are two edits\ntransposed lines are two edits"}
    docs = spark.createDataFrame([(i, t, "e") for i, t in texts.items()] + [(7, texts[7], "e")], "doc_id long, text string, n_lines string")
    got = {r.doc_id: r for r in dedup_lines(docs).collect()}

    def norm(line):
        return re.sub(r"\s+", " ", line.lower()).strip()

    seen = []
    for i, t in texts.items():
        left = []
        for line in (t or "").split("\n"):
            n = norm(line)
            if len(n) < 20 or not any(levenshtein_at_most_one(n, s) for s in seen):
                left.append(line)
            if len(n) >= 20:
                seen.append(n)
        want = None if t is None else "\n".join(left)
        assert got[i].text == want
        assert got[i].n_removed == (0 if t is None else len(t.split("\n")) - len(left))
    assert dedup_lines(docs).count() == len(texts) + 1
    assert dedup_lines(docs.filter("false")).count() == 0


def test_registered_line_dedup_has_no_length_bound(spark, tmp_path):
    from sagebrush.llm.queries import QUERIES

    texts = {1: "nt onor. the of it.\nab\n\nq", 2: "NT onor.  the of it. \nabc\nthe of\n", 3: "nt onor. the of it\nxy\n\nab\nq", 4: "the off\ntha of\nz\n9 lives",
             5: "a line of more than twenty characters\nz\nab", 6: "xyz\nnine lives\na line of more than twenty character"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op1_line_dedup"](spark, str(tmp_path)).collect()}
    seen = []
    for i, text in texts.items():
        left = []
        for line in text.split("\n"):
            n = " ".join(line.lower().split())
            if not n or not any(levenshtein_at_most_one(n, s) for s in seen):
                left.append(line)
            if n:
                seen.append(n)
        assert got[i].n_removed == len(text.split("\n")) - len(left) and got[i].n_lines == len(text.split("\n"))
        assert got[i].kept_sha256 == hashlib.sha256("\n".join(left).encode()).hexdigest()
    assert sum(r.n_removed for r in got.values()) > 8


def test_variants_meet_exactly_within_one_edit():
    from sagebrush.llm.line_dedup import variants

    lines = ["abcd", "abxd", "abd", "abcde", "bacd", "abdc", "aabcd", "zzzz"]
    sets = {s: dict(zip(map(tuple, zip(*[x.tolist() for x in variants(s)], strict=True)), [1] * 99, strict=False)) for s in lines}
    for a in lines:
        for b in lines:
            ka, kb = ({k for k, _ in sets[s]} for s in (a, b))
            whole_a, whole_b = (next(k for k, p in sets[s] if p < 0) for s in (a, b))
            meet = bool(set(sets[a]) & set(sets[b])) or whole_a in kb or whole_b in ka
            assert meet == levenshtein_at_most_one(a, b)


def test_language(docs, nothing, rows, spark):
    from sagebrush.llm.language import Profiles, grams, learn_profiles, predict, ranked, symbols

    other = spark.createDataFrame([(900 + i, "der und ein nicht Straße größer " * 5, "de", "s", 1, "", "", "", "") for i in range(5)], docs.schema)
    both = docs.unionAll(other)
    profiles = learn_profiles(both, 50)
    counts = collections.defaultdict(collections.Counter)
    for r in both.collect():
        if r.lang is not None and r.text is not None:
            text = r.text.lower()
            runs = re.findall(r"[^\W\d_]+", text)
            if runs:
                for w in runs:
                    counts[r.lang].update(tuple(map(ord, w[i:i + 1])) for i in range(len(w)))
                line = "\x01" + "\x01".join(runs) + "\x01"
                pairs = [line[i:i + 2] for i in range(len(line) - 1)]
                counts[r.lang].update(tuple(map(ord, p)) for p in pairs)
                counts[r.lang].update(tuple(map(ord, line[i:i + 3])) for i in range(len(line) - 2) if line[i + 1] != "\x01")
    for lang, counted in counts.items():
        packed = {sum(x << 21 * (len(g) - 1 - k) for k, x in enumerate(g)): n for g, n in counted.items()}
        assert profiles[lang] == sorted(packed, key=lambda g: (-packed[g], g))[:50]
    model = Profiles(profiles, 50)
    own = ranked(grams(symbols("Straße und Haus")), 50)
    for column, lang in enumerate(model.langs):
        plain = sum(min(50, abs(profiles[lang].index(g) - i)) if g in profiles[lang] else 50 for i, g in enumerate(own.tolist()))
        assert model.distances(own)[column] == plain
    got = predict(both, profiles, 50).collect()
    assert len(got) == both.count() and "epoch" in got[0]
    for r in got:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            own = ranked(grams(symbols(r.text)), 50).tolist()
            away = {lang: sum(min(50, abs(p.index(g) - i)) if g in p else 50 for i, g in enumerate(own)) for lang, p in profiles.items()}
            best = min(away, key=lambda x: (away[x], x))
            assert r.lang_pred == best and r.score == pytest.approx(1 - away[best] / (len(own) * 50))
            assert best == "de" or (r.doc_id or 0) < 900
    assert predict(nothing, learn_profiles(nothing)).count() == 0
    assert {r.lang_pred for r in predict(docs, {}).collect()} == {"und"}


def test_registered_language_query_learns_outside_the_held_out_fold(spark):
    from sagebrush.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = QUERIES["op2_language_id"](spark, sf).collect()
    assert sorted(r.doc_id for r in found) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in found)
    judged = [r for r in found if r.held_out and docs[r.doc_id].lang and any(c.isalpha() for c in docs[r.doc_id].text or "")]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in judged) >= 0.98 * len(judged) > 100


def test_lm(docs, nothing, rows, lower):
    from sagebrush.llm.common import fold
    from sagebrush.llm.lm import score

    got = score(docs, fold(F.col("doc_id"), 5) == 1, block_tokens=400).collect()
    assert len(got) == len(rows)
    held = {r[0]: zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 1 for r in rows}
    tokens = [(r[0], re.findall(WORD, lower(r[1] or "")) + ["\0"]) for r in rows]
    words, pairs = collections.Counter(), collections.Counter()
    for i, w in tokens:
        if not held[i]:
            words.update(w)
            pairs.update(zip(["^"] + w, w, strict=False))
    n, v = sum(words.values()), len(words)
    before, context = collections.Counter(w for _, w in pairs), collections.defaultdict(lambda: [0] * 4)
    for (a, _), c in pairs.items():
        context[a][0] += c
        context[a][min(c, 3)] += 1

    def discounts(counts):
        n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        return [0.0] + [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0), k) if n[k - 1] else float(k) and 0.0 for k in (1, 2, 3)]

    d, e, every = discounts(pairs.values()), discounts(before.values()), sum(before.values())
    free = sum(e[min(c, 3)] for c in before.values()) / every

    def low(w):
        return max(before[w] - e[min(before[w], 3)], 0) / every + free / (v + 1)

    def p(a, w):
        if a not in context:
            return low(w)
        total, *k = context[a]
        return max(pairs[a, w] - d[min(pairs[a, w], 3)], 0) / total + sum(x * y for x, y in zip(d[1:], k, strict=True)) / total * low(w)

    want = collections.Counter()
    for i, w in tokens:
        s = sum(math.log10(p(a, x)) for a, x in zip(["^"] + w, w, strict=False))
        b = sum(math.log10((words[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        want[(i, held[i], len(w), sum(words[x] > 0 for x in w), n, round(b, 6), round(s, 6))] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == want
    assert abs(sum(p("the", w) for w in words) + p("the", "never seen") - 1) < 1e-9
    assert score(nothing, fold(F.col("doc_id"), 5) == 1).count() == 0
    alone = score(docs, F.lit(True)).filter("n_tokens = 1").collect()
    assert all(r.train_tokens == 0 and r.score == 0.0 for r in alone)


def test_lm_of_trigrams(spark, docs, nothing, rows, lower, tmp_path):
    from sagebrush.llm.common import fold
    from sagebrush.llm.lm import discounts, score
    from sagebrush.llm.queries import QUERIES

    held = {r[0]: zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 1 for r in rows}
    tokens = [(r[0], ["^"] + re.findall(WORD, lower(r[1] or "")) + ["\0"]) for r in rows]
    words, pairs, triples = collections.Counter(), collections.Counter(), collections.Counter()
    for i, w in tokens:
        if not held[i]:
            words.update(w[1:])
            pairs.update(zip(w, w[1:], strict=False))
            triples.update(zip(w, w[1:], w[2:], strict=False))
    after = collections.Counter((b, c) for _, b, c in triples)
    after.update({(a, b): n for (a, b), n in pairs.items() if a == "^"})
    before, v = collections.Counter(w for _, w in pairs), len(words)

    def contexts(counts):
        out = collections.defaultdict(lambda: [0] * 4)
        for gram, c in counts.items():
            out[gram[:-1]][0] += c
            out[gram[:-1]][min(c, 3)] += 1
        return out

    levels = [(counts, contexts(counts), discounts(*(sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)))) for counts in (after, triples)]
    e, every = discounts(*(sum(c == k for c in before.values()) for k in (1, 2, 3, 4))), sum(before.values())
    free = sum(e[min(c, 3)] for c in before.values()) / every

    def p(gram):
        if len(gram) == 1:
            return max(before[gram[0]] - e[min(before[gram[0]], 3)], 0) / every + free / (v + 1)
        counts, context, d = levels[len(gram) - 2]
        if gram[:-1] not in context:
            return p(gram[1:])
        total, *k = context[gram[:-1]]
        return max(counts[gram] - d[min(counts[gram], 3)], 0) / total + sum(x * y for x, y in zip(d[1:], k, strict=True)) / total * p(gram[1:])

    want = collections.Counter((i, len(w) - 1, round(sum(math.log10(p(tuple(w[max(0, k - 2):k + 1]))) for k in range(1, len(w))), 6)) for i, w in tokens)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for got in (score(docs, fold(F.col("doc_id"), 5) == 1, 400, order=3), QUERIES["op3_lm_score"](spark, str(tmp_path))):
        assert collections.Counter((r.doc_id, r.n_tokens, round(r.score, 6)) for r in got.collect()) == want
    seen = next(g[:2] for g, c in triples.items() if c > 1)
    for context in (seen, ("^", tokens[0][1][1]), ("never", "seen")):
        assert abs(sum(p((*context, w)) for w in words) + p((*context, "never seen")) - 1) < 1e-9
    assert score(nothing, F.lit(False), order=3).count() == 0
    alone = score(docs, F.lit(True), order=3).collect()
    assert all(r.train_tokens == 0 and r.score == 0.0 for r in alone)
    assert score(docs.filter("doc_id in (500, 501)"), F.lit(False), order=3).count() == 2


def test_token_output(docs, nothing, rows):
    import public_tokenizers
    import tokenizers

    from sagebrush.llm.token_output import Encoder, op4_token_output

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = sorted(((r.start, r) for r in op4_token_output(docs).collect()), key=lambda x: x[0])
    at = 0
    for start, r in got:
        assert start == at
        at += r.n_tokens
    assert [key(r.doc_id) for _, r in got] == sorted(key(r[0]) for r in rows)
    want = collections.Counter()
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want[(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for _, r in got) == want
    assert op4_token_output(nothing).count() == 0
    odd = ["a  b\t\tc\n\nd", "Ünïcode é ́x  ́", "ΑΣ ΑΣ. Σ", "it's 's 'll we'll ' s don'T.'", "<|endoftext|> x<|startoftext|>y <|endof text>", "\x1c\x1d a\x85b  c​",
           "日本語。 テスト, 123 4 5%.", "", "   ", "\x00\x01 \x7f", "👩‍👩‍👧 family!", "İstanbul ǅ ß ẞ.", "à́ b̧́,", " ̸=", "x. ̸y", "KELVIN K.", "é.. ½. a.b ..a"]
    encoder = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert encoder.by_word
    for text in odd:
        assert encoder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("size", [0, 1, 3, 4, 5, 1000])
def test_byte_code_round_trip(size):
    from sagebrush.llm.token_output import decode_file, encode_file, pack, unpack

    rng = np.random.default_rng(size)
    values = (rng.integers(0, 1 << 32, size) >> rng.integers(0, 32, size)).astype("<u4")
    control, data = pack(values)
    assert len(control) == -(-size // 4)
    assert (unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), size) == values).all()
    ids = rng.integers(0, 50_000, size)
    keys, sizes, back = decode_file(encode_file([None, 5], np.array([size // 2, size - size // 2]), ids))
    assert keys == [None, 5] and sizes.sum() == size and (back == ids).all()


def test_golomb_round_trip():
    from sagebrush.llm.golomb import decode, encode

    rng = np.random.default_rng(4)
    for values in ([], [7], [0, 1 << 64 - 1], [5, 5, 5], list(range(100)), rng.integers(0, 1 << 63, 1000).tolist()):
        values = np.sort(np.array(values, np.uint64))
        assert (decode(encode(values)) == values).all()


def test_toxicity(spark, nothing):
    import random

    from sagebrush.llm.toxicity import THRESHOLD, learn, score

    rng = random.Random(1)
    words = [f"word{i}" for i in range(300)]
    made = []
    for i in range(900):
        own = [rng.choice(words) for _ in range(40)]
        if i % 6 == 0:
            own[rng.randrange(40)] = rng.choice(["vile", "nasty", "horrid"])
            own[rng.randrange(40)] = rng.choice(["vile", "nasty", "horrid"])
        made.append((i, " ".join(own), int(i % 6 == 0)))
    made += [(None, None, None), (1000, "", 0), (1001, None, 0), (1002, "vile " * 20_000, None)]
    docs = spark.createDataFrame([(a, b, "c") for a, b, _ in made] + [(3, made[3][1], "c")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(a, c) for a, _, c in made if a is None or a % 3], "doc_id long, toxic int").unionAll(
        spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    # ids divisible by 3 are held out: the toxic ones among the others teach
    labels = labels.unionAll(spark.createDataFrame([(a, c) for a, _, c in made if a is not None and a % 12 == 0 and a < 900], "doc_id long, toxic int"))
    model = learn(docs, labels)
    got = {r.doc_id: r for r in score(docs, model, F.col("doc_id") == 5).collect()}
    assert len(score(docs, model).collect()) == len(made) + 1
    tests = [(a, c) for a, _, c in made if a is not None and c is not None and a % 12 == 6 and a < 900]
    assert sum(got[a].predicted for a, _ in tests) >= 0.75 * len(tests)
    clean = [a for a, _, c in made if c == 0]
    assert sum(got[a].predicted for a in clean) <= 0.02 * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= THRESHOLD) for r in got.values())
    assert got[5].held_out and not got[6].held_out and got[1002].score > got[1000].score
    empty = score(docs, learn(docs, labels.filter("toxic = 0"))).collect()
    assert {r.score for r in empty} == {0.0}
    bare = nothing.select("doc_id", "text")
    assert score(bare, learn(bare, labels)).count() == 0


def test_mixing(docs, nothing, rows):
    from sagebrush.llm import mixing

    tokens = [100.0, 10.0, 10.0, 1.0]
    for target in (0.5, 0.8, 0.99):
        a = mixing.exponent_for(tokens, target, 1e9)
        h = mixing.entropy(mixing.weights_at(tokens, a)) / math.log(4)
        assert h >= target - 1e-9 and (a == 1.0 or h < target + 1e-6)
    a = mixing.exponent_for(tokens, 0.99, 4.0)
    assert abs(max(mixing.epochs_at(tokens, a, None)) - 4.0) < 1e-6
    with pytest.raises(ValueError):
        mixing.exponent_for(tokens, 0.9, 2.0, budget=1000.0)
    assert mixing.exponent_for([5.0], 0.95) == 1.0
    got = mixing.mix(docs).collect()
    n = collections.Counter()
    for r in rows:
        n[r[3]] += len(re.findall(WORD, r[1] or "")) + 1
    planned = {s: (whole, rest, w) for s, whole, rest, _, w in mixing.plan(sorted(n.items(), key=lambda x: (x[0] is not None, x[0])))}
    drawn, per_epoch = collections.Counter(), collections.defaultdict(collections.Counter)
    for r in got:
        drawn[r.source] += r.n_tokens
        per_epoch[r.source][int(r.epoch)] += r.n_tokens
    largest = collections.Counter()
    for r in rows:
        largest[r[3]] = max(largest[r[3]], len(re.findall(WORD, r[1] or "")) + 1)
    for s, (whole, rest, _) in planned.items():
        assert all(per_epoch[s][e] == n[s] for e in range(whole)) and per_epoch[s][whole] <= rest
        assert n[s] * whole + rest - 2 * largest[s] <= drawn[s] <= n[s] * whole + rest
    assert {r.doc_id for r in got} == {r[0] for r in rows}      # nothing is lost under the default budget
    half = mixing.mix(docs, budget=sum(n.values()) / 2).collect()
    assert sum(r.n_tokens for r in half) <= sum(n.values()) / 2
    assert mixing.mix(nothing).count() == 0


@pytest.mark.parametrize("block", [4_000_000, 150])
def test_mixing_draws(docs, rows, monkeypatch, block):
    """Which rows are drawn, and how often, by a plain walk through the permutation of every source's last epoch."""
    import xxhash

    from sagebrush.llm import mixing

    monkeypatch.setattr(mixing, "BLOCK_TOKENS", block)

    def chained(*values):
        seed = 42
        for v in values:
            data = v.encode() if isinstance(v, str) else v
            seed = xxhash.xxh64_intdigest(data, seed)
        return seed - (1 << 64) if seed >> 63 else seed

    sized = collections.defaultdict(list)
    for i, t, _, source, *_ in rows:
        k = chained(*([] if i is None else [str(i)]), t or "")
        sized[source].append((i, k, len(re.findall(WORD, t or "")) + 1))
    counts = sorted(((s, sum(n for *_, n in own)) for s, own in sized.items()), key=lambda x: (x[0] is not None, x[0]))
    total = sum(n for _, n in counts)
    for budget in (None, total / 2, total * 1.7):
        want = collections.Counter()
        for s, whole, rest, blocks, _ in mixing.plan(counts, budget=budget):
            for epoch in range(whole + 1):
                drawn = [(chained(k.to_bytes(8, "little", signed=True), epoch.to_bytes(4, "little"), (7).to_bytes(4, "little")), i, n)
                         for i, k, n in sized[s]]
                order = sorted(drawn, key=lambda x: (x[0] % blocks, x[0]))
                room = rest if epoch == whole else total
                # rows of one draw, which repeat each other, go together
                groups = collections.defaultdict(list)
                for d, i, n in order:
                    groups[d % blocks, d].append((i, n))
                for (b, _), own in groups.items():
                    room -= sum(n for _, n in own)
                    if room < 0:
                        break
                    want.update((i, s, n, epoch, b) for i, n in own)
        got = mixing.mix(docs, budget=budget).select("doc_id", "source", "n_tokens", "epoch", "block").collect()
        assert collections.Counter(tuple(r) for r in got) == want


def test_columns_of_any_name_pass(spark, docs, nothing):
    """Extra columns named as the operators' inner ones change no result and come back as they were."""
    from sagebrush.llm import decontaminate, exact_dedup, language, lm, mixing, repeats, simhash, token_output
    from sagebrush.llm.line_dedup import dedup_lines

    names = ["_rk", "_k", "_kept", "_did", "_own_rk", "_own_did", "_key", "_source", "_draw", "_s", "_whole", "_rest", "_blocks", "_cut", "_last",
             "_row", "_text", "_TEXT", "_dropped", "_gone", "_letters", "_id", "did", "rk", "norm", "key", "place", "part", "sha", "size", "suspect",
             "best", "root", "h", "g", "at", "keys", "h 1"]
    few = docs.filter("length(text) < 2000 or text is null").select("doc_id", "text", "lang", "source")
    wide = few.withColumns({n: F.concat(F.lit(f"{n}:"), F.col("source")) for n in names if n != "_TEXT"})
    bench = spark.createDataFrame([(1, few.filter("doc_id = 0").first().text)], "item_id long, text string")

    def plain(df):
        return collections.Counter(str(sorted(r.asDict(True).items(), key=str)) for r in df.collect())

    for run in (lambda d: dedup_lines(d, 1), mixing.mix, exact_dedup.deduplicate, exact_dedup.exact_groups, simhash.keep_one, simhash.op8_simhash,
                lambda d: decontaminate.decontaminate(d, bench), lambda d: decontaminate.op9_decontaminate(d, bench),
                lambda d: language.predict(d, language.learn_profiles(d)), lambda d: lm.score(d, F.lit(False)), repeats.op10_repeats,
                token_output.op4_token_output):
        base, more = run(few), run(wide)
        assert plain(more.select(base.columns)) == plain(base)
        extra = [c for c in names if c in more.columns]
        if extra and len(base.columns) < len(more.columns):
            assert [c for c in names if c != "_TEXT"] == extra
            for r in more.collect():
                assert all(r[c] == (None if r.source is None else f"{c}:{r.source}") for c in extra)
        assert run(wide.filter("false")).count() == 0


def test_exact_dedup(docs, nothing, rows):
    from sagebrush.llm.exact_dedup import deduplicate, exact_groups

    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(BLANKS, "", t or "")].append((-len(t or ""), key(i), i))
    want = collections.Counter()
    for norm, own in groups.items():
        keep = min(own)[2] if all(k[2] is not None for k in own) else min(own, key=lambda x: x[:2])[2]
        for *_, i in own:
            want[(i, keep, len(own), i == keep, hashlib.sha256(norm.encode()).hexdigest())] += 1
    got = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_groups(docs).collect())
    assert got == want
    assert exact_groups(nothing).count() == 0
    assert deduplicate(docs).columns == docs.columns


def simhash(text, lower):
    import xxhash

    words = re.findall(WORD, lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(shingles))


def classes(codes, ids, distance=3):
    """Smallest id reachable over links, by plain search."""
    codes, parent = np.array(codes, np.uint64), list(range(len(codes)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[i + 1:] ^ codes[i]) <= distance) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    low = {}
    for i in range(len(codes)):
        low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return [low[find(i)] for i in range(len(codes))]


def test_simhash(docs, nothing, rows, lower):
    from sagebrush.llm.simhash import keep_one, op8_simhash

    own = [(r[0], simhash(r[1], lower)) for r in rows]
    named = [(i, f) for i, f in own if i is not None]
    want = collections.Counter((i, f"{f:016x}", c) for (i, f), c in zip(named, classes([f for _, f in named], [i for i, _ in named]), strict=True))
    want.update((None, f"{f:016x}", None) for i, f in own if i is None)
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in op8_simhash(docs).collect()) == want
    assert op8_simhash(nothing).count() == 0
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(i for i, _, c in want.elements() if i == c)


@pytest.mark.parametrize("bucket", [20_000, 20])
def test_simhash_links_in_full_and_redealt_buckets(spark, monkeypatch, bucket):
    from sagebrush.llm import simhash as S

    monkeypatch.setattr(S, "BUCKET", bucket)
    rng = np.random.default_rng(bucket)
    centres = rng.integers(0, 1 << 63, 30, np.uint64)
    codes = [0, (1 << 64) - 1]
    for c in centres.tolist() + [0xFFFF] * 3:
        for _ in range(8):
            x = c
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(b)
            codes.append(x)
    codes += [0xABCD << 48 | int(x) for x in rng.integers(0, 1 << 48, 60)]      # one value of a segment
    codes = list(dict.fromkeys(codes))
    ids = list(range(10, 10 + len(codes)))
    nodes = spark.createDataFrame([(int(np.uint64(c).view(np.int64)), i) for c, i in zip(codes, ids, strict=True)], "fp long, id long")
    found = {r.u: r.root for r in S.components(S.links(nodes)).collect()}
    assert [found.get(i, i) for i in ids] == classes(codes, ids)


def test_decontamination(spark, docs, nothing, rows, lower):
    from sagebrush.llm.decontaminate import decontaminate, find_contamination, op9_decontaminate, with_char_spans

    texts = [r[1] for r in rows if r[1]]
    items = [(1, " ".join(texts[0].split()[:14])), (2, "SEVEN maps"), (10, " ".join(texts[3].split()[-20:]).upper()), (3, None), (4, ""), (5, "?!"),
             (None, " ".join(texts[8].split()[5:16])), (1, " ".join(texts[9].split()[:10])), (6, "ab " * 10), (7, "語")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = word.findall(lower(t or ""))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k:k + 10])].add("null" if i is None else str(i))
    sizes = {len(w) for w in windows}
    want = collections.Counter()
    for i, t, *_ in rows:
        w = word.findall(lower(t or ""))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k:k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        want[(i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))] += 1
    assert collections.Counter(tuple(r) for r in op9_decontaminate(docs, bench).collect()) == want
    blocks = find_contamination(docs, bench, block_bytes=200)       # several automata in a row
    assert collections.Counter((r.doc_id, r.n_words, sum(s["end"] - s["start"] for s in r.word_spans), len(r.item_ids)) for r in blocks.collect()) == \
        collections.Counter(x[:4] for x in want.elements())
    for r in with_char_spans(find_contamination(docs, bench)).collect():
        for w, c in zip(r.word_spans, r.spans, strict=True):
            piece = r.text[c["start"]:c["end"]]
            assert len(word.findall(lower(piece))) == w["end"] - w["start"]
    clean = decontaminate(docs, bench)
    assert set(clean.columns) == set(docs.columns)
    assert clean.count() == sum(n for x, n in want.items() if not x[5])
    assert op9_decontaminate(nothing, bench).count() == 0
    assert not any(r.contaminated for r in op9_decontaminate(docs, bench.filter("false")).collect())


@pytest.mark.parametrize("hot,block", [(200_000, 8 << 20), (2, 40_000), (0, 1 << 20)])
def test_repeats(docs, nothing, rows, hot, block):
    from sagebrush.llm import repeats as R

    unique = docs.dropDuplicates(["doc_id"])
    seen, want = set(), {}
    for i, t in sorted({r[0]: r[1] for r in rows}.items(), key=lambda x: key(x[0])):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 99):
            if data[k:k + 100] in seen:
                gone[k:k + 100] = b"\x01" * 100
            seen.add(data[k:k + 100])
        left = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        want[i] = (len(data), sum(gone), len(re.findall(b"\x01+", bytes(gone))), left)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in R.remove_repeats(unique, block_bytes=block, hot=hot).collect()}
    assert got == want
    assert R.remove_repeats(docs).count() == len(rows)      # rows that repeat an id
    assert R.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("block,held", [(1 << 15, 1 << 21), (7, 11)])
def test_induced_sorting(tmp_path, monkeypatch, block, held):
    import random

    from sagebrush.llm import induced

    monkeypatch.setattr(induced, "BLOCK", block)
    monkeypatch.setattr(induced, "HELD", held)
    rng = random.Random(block)
    texts = [b"mississippi", b"a", b"aaaaaaa", b"abababab", b"ba" * 30 + b"a" * 20, bytes(range(255, -1, -1)), bytes(range(256))]
    texts += [bytes(rng.randrange(rng.choice([1, 2, 30])) + 97 for _ in range(rng.randint(1, 150))) * rng.choice([1, 2, 3]) for _ in range(60)]
    for number, text in enumerate(texts):
        for depth in (8, 100):
            folder = tmp_path / f"{number}-{depth}"
            folder.mkdir()
            rows = np.concatenate(list(induced.sorted_suffixes(np.frombuffer(text, np.uint8), str(folder), depth)))
            at = rows["at"].tolist()
            assert sorted(at) == list(range(len(text)))
            for a, b, common in zip(at, at[1:], rows["common"][1:].tolist(), strict=False):
                x, y = text[a:a + depth], text[b:b + depth]
                n = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
                assert x <= y and (common == n if n < depth else common >= depth)


def test_counts_of_any_size_survive_a_message():
    from sagebrush.llm.lm import _loosen, _squeeze

    columns = [np.array([0, 1, 254, 255, 256]), np.array([2**32 - 1, 2**32, 2**40 + 3, 7, 255])]
    back = _loosen(_squeeze(columns), 5, 2)
    assert [c.tolist() for c in back] == [c.tolist() for c in columns]
    assert [c.tolist() for c in _loosen(_squeeze([np.zeros(0, np.int64)]), 0, 1)] == [[]]


def test_distinct_keys_with_places():
    from sagebrush.llm.lm import _distinct

    keys = np.random.default_rng(3).integers(0, 50, 1000).astype(np.uint64)
    values, place, at = _distinct(keys)
    assert values.tolist() == sorted(set(keys.tolist())) and (keys[place] == values).all() and (values[at] == keys).all()
    assert [len(x) for x in _distinct(keys[:0])] == [0, 0, 0]
