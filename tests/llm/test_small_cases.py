"""Defined results of every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import base64
import hashlib
import html
import itertools
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridlake.llm import arrays, chat, decontam, html_text, line_dedup, packing, quality, secrets, token_files, warc
from gridlake.llm.tokens import Encoder

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
SPACE = " \t\n\x0b\x0c\r"


def texts(spark, rows, parts=2):
    """Documents with further columns whose names clash with the operators' own."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return df.withColumns({"n": F.lit(1), "key": F.lit("k"), "length": F.lit(-1), "piece": F.lit("p"), "part": F.lit(0), "kept": F.lit(None).cast("boolean")})


@pytest.fixture(scope="module")
def odd():
    rnd = random.Random(1)
    line = "This line is long enough to count as one of the repeated lines."
    long = " ".join(rnd.choice(["alpha", "beta,", "gamma.", "delta"]) for _ in range(30_000))
    return [
        (1, None), (2, ""), (3, " \t\n\x0b "), (4, "one"), (5, "a  b\n\n c d é 漢字 🙂"), (6, long), (7, f"{line}\n{line}\nother"), (8, f"  {line.upper()} \nx"), (9, f"{line}\t\ny"),
        (10, f"{line}\nz"), (11, f"w\n{line}"), (11, f"w\n{line}"), (None, f"{line}\nnull id"), (12, "\n\n"), (13, "x " * 60),
    ]


def test_tokens_equal_the_library():
    e, t = Encoder(TOKENIZER, 2), Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    rnd = random.Random(2)
    cases = ["", " ", "a", "\0 a \0", "it's  x's  y", "<|endoftext|> a", "A b   c", "٣ Ⅷ ½ ª"] + ["".join(rnd.choice("ab1,'. \n\té漢 ́") for _ in range(rnd.randint(0, 20))) for _ in range(3000)]
    for case, got in zip(cases, e.encode(cases), strict=True):
        assert np.frombuffer(got, e.kind).tolist() == [*t.encode(case, add_special_tokens=False).ids, 2]


def expected_ids(rows):
    t = Tokenizer.from_file(TOKENIZER)
    return [(d, np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")) for d, x in rows]


def test_token_files(spark, odd):
    manifest = token_files.write(texts(spark, odd), TOKENIZER, 2, length=64)
    got = sorted((tuple(r) for r in token_files.read(manifest).collect()), key=lambda r: r[1])
    ids = expected_ids(odd)
    assert sorted(str((d, n, c)) for d, _, n, c in got) == sorted(str((d, len(x), zlib.crc32(x.tobytes()))) for d, x in ids)
    assert [r[1] for r in got] == [sum(r[2] for r in got[:k]) for k in range(len(got))]
    known = [r[0] for r in got if r[0] is not None]
    assert known == sorted(known) and got[0][0] is None
    shard = max(manifest.collect(), key=lambda r: r.n_sequences)
    rows = token_files.open_shard(shard.ids_file).read_all()
    flat, mask = (np.array(rows.column(k).to_pylist()) for k in (0, 1))
    assert flat.shape == (shard.n_sequences, 64) and mask.sum() == shard.n_tokens
    for k in {0, 1, 511, 512, shard.n_sequences - 1} & set(range(shard.n_sequences)):
        one, own = token_files.sequence(shard.ids_file, k)
        assert np.array_equal(one, flat[k]) and np.array_equal(own, mask[k]) and not (one.flags.owndata or own.flags.owndata)
    assert token_files.read(token_files.write(texts(spark, odd).limit(0), TOKENIZER, 2)).collect() == []


def plain_best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(capacity - n)
    return sorted(room)


def test_best_fit_decreasing_is_exact():
    rnd = random.Random(3)
    for capacity in (1, 7, 64):
        for _ in range(30):
            lengths = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 200))]
            runs, bins = packing.best_fit_decreasing({n: lengths.count(n) for n in set(lengths)}, capacity)
            assert bins == len(plain_best_fit(lengths, capacity))
            assert len(runs) <= capacity * capacity + 1


def test_packing(spark, odd):
    got = packing.pack_documents(texts(spark, odd), TOKENIZER, 2, 64).collect()
    ids = expected_ids(odd)
    assert sorted((sum(r.length for r in got if r.doc_id == d)) for d in {r.doc_id for r in got}) == sorted(sum(len(x) for e, x in ids if e == d) for d in {d for d, _ in ids})
    for d, x in ids:
        if d in (6, 13):
            at = 0
            for r in sorted((r for r in got if r.doc_id == d), key=lambda r: r.piece):
                assert r.start == at and r.ids_crc32 == zlib.crc32(x[at : at + r.length].tobytes()) and (r.piece == 0 or r.length == 64)
                at += r.length
            assert at == len(x)
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert len({r.sequence_id for r in got}) == len(plain_best_fit([r.length for r in got], 64))
    assert packing.pack_documents(texts(spark, odd).limit(0), TOKENIZER, 2, 64).collect() == []


def test_packing_moves_no_pieces(spark):
    rnd = random.Random(4)
    rows = [(d, "same text " * 3 if d % 2 else " ".join(rnd.choice("abcdef") for _ in range(rnd.randint(0, 150)))) for d in range(600)]
    packed = packing.pack_documents(texts(spark, rows, 7), TOKENIZER, 2, 64)
    # Pieces are placed where they were read: a shuffle would write as many files as it has partitions, and sort every piece.
    assert not re.search("Exchange|Sort|Window|Join", packed._jdf.queryExecution().sparkPlan().toString() + packed._jdf.queryExecution().executedPlan().toString())
    whole_and_few_sequences(packed.collect(), 64, sum(len(x) for _, x in expected_ids(rows)))
    items = spark.range(0, 5000, 1, 9).select("id", (F.col("id") % 9 * 7 + 1).cast("int").alias("length"), F.lit("x").alias("chunk"), F.lit(-1).alias("before"))
    placed = packing.pack(items.where("id % 9 < 4 or id > 2000").repartition(40, "length"), 64)
    assert placed.columns == ["id", "length", "chunk", "before", "sequence_id", "offset"] and dict(placed.dtypes)["length"] == "int"
    rows = placed.collect()
    assert len({r.id for r in rows}) == len(rows) and {(r.chunk, r.before) for r in rows} == {("x", -1)}
    whole_and_few_sequences(rows, 64, sum(i % 9 * 7 + 1 for i in range(5000) if i % 9 < 4 or i > 2000))
    for bad in (None, 0, 65):
        with pytest.raises(ValueError, match="length"):
            packing.pack(spark.createDataFrame([(3,), (bad,)], "length long"), 64)


def whole_and_few_sequences(rows, capacity, tokens):
    """Every token is in a sequence, sequences have no gaps and no overlap, and there are as few as best-fit decreasing gives."""
    assert sum(r.length for r in rows) == tokens
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= capacity
    assert len(ends) == len(plain_best_fit([r.length for r in rows], capacity))


def test_line_dedup(spark, odd, monkeypatch):
    monkeypatch.setattr(line_dedup, "KEYS_A_SHARD", 1)
    key = lambda x: x.strip(SPACE).translate(LOWER)
    rank = lambda d: -1 if d is None else d
    holders = {}
    for d, t in odd:
        for k in {key(x) for x in (t or "").split("\n")}:
            holders.setdefault(k, []).append(rank(d))
    want = []
    for d, t in odd:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(key(x)) < 40 or len(holders[key(x)]) < 5 or max(holders[key(x)]) == rank(d)]
        want.append(str((d, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest())))
    got = line_dedup.drop_lines(texts(spark, odd), digest=True).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(want)
    whole = line_dedup.drop_lines(texts(spark, odd))
    assert whole.columns == texts(spark, odd).columns and whole.count() == len(odd)
    assert line_dedup.drop_lines(texts(spark, odd).limit(0), digest=True).collect() == []


@pytest.mark.parametrize("least", [5, 300])
def test_line_arrays_hold_counts_and_ids(least, monkeypatch):
    rng = np.random.default_rng(2)
    key, mark = (rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2) for _ in "ab")
    key[:50] = key[50:100]  # one hash, other marks
    n, last = rng.integers(2, 400, 3000), rng.integers(-9, 1 << 40, 3000)
    shard = line_dedup.Shard(pa.py_buffer(line_dedup.shard_bytes(key, mark, n, last, least)), least)
    got, ids = shard.probe(np.concatenate((key, key + np.uint64(1))), np.concatenate((mark, mark ^ np.uint64(0x5555))))
    assert np.array_equal(got[:3000], n if least > 255 else np.minimum(n, 255)) and not got[3000:].any()
    assert np.array_equal(ids[:3000][n >= least], last[n >= least])
    tried = []
    plain = line_dedup._joint
    monkeypatch.setattr(line_dedup, "_joint", lambda k, m, salt: tried.append(salt) or (plain(k, m, salt) if salt else np.zeros_like(k)))
    again = line_dedup.Shard(pa.py_buffer(line_dedup.shard_bytes(key, mark, n, last, least)), least)
    assert tried == [0, 1] and np.array_equal(again.probe(key, mark)[0], got[:3000])


def test_line_dedup_over_many_shards(spark, monkeypatch):
    for name, value in {"KEYS_A_SHARD": 7, "GATHERED_BYTES": 20_000, "CACHED_BYTES": 1}.items():
        monkeypatch.setattr(line_dedup, name, value)
    rnd = random.Random(3)
    lines = [f"line number {k} which is long enough to be taken for a key" for k in range(400)]
    rows = [(d, "\n".join(rnd.choices(lines, [1 / (k + 1) for k in range(400)], k=rnd.randint(1, 30)))) for d in rnd.sample(range(10**6), 300)]
    holders = {}
    for d, t in rows:
        for x in set(t.split("\n")):
            holders.setdefault(x, []).append(d)
    want = {d: "\n".join(x for x in t.split("\n") if len(holders[x]) < 5 or max(holders[x]) == d) for d, t in rows}
    assert {r.doc_id: r.text for r in line_dedup.drop_lines(texts(spark, rows)).collect()} == want


def test_quality_sample_is_bounded_and_no_prefix(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_PARTS", 3)
    df = spark.range(5000).repartition(9).select(F.concat(F.lit("text number "), F.col("id")).alias("text"))
    got = quality.sample(df)
    assert len(got) == len(set(got)) == 750
    first = [r.text for r in df.collect()[:750]]
    assert len(set(first) & set(got)) < 500
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 1000)
    assert 0 < sum(map(len, quality.sample(df))) * 4 <= 3000
    assert quality.sample(df.select(F.repeat("text", 100).alias("text"))) == [] and quality.sample(df.limit(0)) == []


def test_minimal_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 5000).astype(np.uint64))
    made = line_dedup.MinimalPerfectHash.build(keys)
    assert sorted(made(keys).tolist()) == list(range(len(keys)))
    assert line_dedup.MinimalPerfectHash.build(np.repeat(keys, 2)) is None
    assert (made(keys + np.uint64(1)) < len(keys)).all() and len(line_dedup.MinimalPerfectHash.build(keys[:0])(keys)) == len(keys)


def test_quality(spark, odd):
    got = quality.judge(texts(spark, odd)).collect()
    want = []
    for d, t in odd:
        t = t or ""
        w = WORD.findall(t)
        three = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        twice = {x for x in set(three) if three.count(x) > 1} if len(three) < 5000 else set(three)
        again = {k + j for k, x in enumerate(three) if x in twice for j in range(3)}
        seen, dup = set(), 0
        for x in t.split("\n"):
            if WORD.search(x):
                dup += x in seen
                seen.add(x)
        want.append(str((d, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(again), len(w) < 50 or 2 * len(again) > len(w))))
    assert sorted(str(tuple(r)[:7]) for r in got) == sorted(want)
    assert all(not r.kept for r in got if r.base_failed)
    rows = quality.judge(texts(spark, odd), rows=True)
    assert rows.columns == texts(spark, odd).columns
    assert quality.judge(texts(spark, odd).limit(0)).collect() == []


def test_rule_order_does_not_change_the_verdict(spark):
    rnd = random.Random(5)
    rows = [(k, " ".join(rnd.choice(["word", "thing", "12", "###", "x", "of"]) + str(rnd.randint(0, 400)) * (k % 2) for _ in range(80))) for k in range(60)]
    df = texts(spark, rows)
    orders = [dict(sorted(quality.RULES.items())), dict(sorted(quality.RULES.items(), reverse=True))]
    a, b = ({r.doc_id: r.kept for r in quality.judge(df, o).collect()} for o in orders)
    assert a == b


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def test_secrets(spark, odd):
    rnd = random.Random(6)
    draw = lambda alphabet, n: "".join(rnd.choice(alphabet) for _ in range(n))
    more = [
        (20, 'é PassWord: "hunter22x" then token = short secret:abcdefgh12 api_key=AAAA.BBBB-CCCC'), (21, "AKIA" + draw("ABCDEF0123", 12) + " AKIA123 xAKIAAKIA" + "Z" * 20),
        (22, "deadbeef" * 4 + " " + "0" * 31 + " " + "a1" * 40), (23, "🙂 token=token=12345678 apikey : 'zzzzzzzz'"), (24, draw("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 64)),
    ]
    plain = [(100 + k, " ".join(f"{'ab' * 9}{k % 7}ab" for _ in range(3))) for k in range(20)]
    strong = [(200 + k, draw("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 44)) for k in range(60)]
    rows = [*odd, *more, *plain, *strong]
    got = secrets.digests(secrets.find_secrets(texts(spark, rows))).collect()
    want, number = {}, {}
    for d, t in rows:
        t = t or ""
        found = sorted(
            [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 8] + [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        )
        want[d] = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in found).encode()).hexdigest()
        number[d] = tuple(sum(f[3] == k for f in found) for k in ("assign", "access", "hex"))
    assert len(got) == len(rows) and all(r.base_sha256 == want[r.doc_id] and (r.n_assign, r.n_access, r.n_hex) == number[r.doc_id] for r in got)
    spans = {r.doc_id: r.spans for r in got}
    assert sum("random" in spans[d] for d, _ in strong) >= 50 and not any("random" in spans[d] for d, _ in plain)
    assert secrets.find_secrets(texts(spark, odd).limit(0)).collect() == []


def test_running_folds_and_substrings(spark):
    for n in (0, 1, 127, 128, 129, 16_385):
        df = spark.createDataFrame([([(7 * k) % 11 for k in range(n)], "é🙂x" * n, [(k, 3 * n - k) for k in range(0, n, 1 + n // 50)])], "x array<int>, t string, s array<struct<start:int,end:int>>")
        r = df.select("x", "t", "s", arrays.running_sums(F.col("x")).alias("sums"), arrays.running(F.col("x"), F.greatest, F.lit(-1)).alias("most"), arrays.substrings(F.col("t"), F.col("s")).alias("parts")).first()
        assert r.sums == [0, *itertools.accumulate(r.x)][:n] and r.most == [-1, *itertools.accumulate(r.x, max)][:n]
        assert r.parts == [r.t[a:b] for a, b in r.s]


def test_many_matches_and_turns_take_linear_time(spark):
    """Folds that copy what they have took minutes for these."""
    n = 40_000
    tokens = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.concat(F.lit("token=abcdefgh"), k.cast("string"), F.lit(" x9"), F.sha1(k.cast("string"))))
    began = time.time()
    row = secrets.digests(secrets.find_secrets(spark.range(1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", tokens).alias("text")))).first()
    assert (row.n_assign, row.n_hex) == (n, n)
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("some text").alias("text"))
    row = chat.digests(chat.format_chats(turns)).first()
    assert (row.n_turns, row.loss_chars) == (n, n // 2 * 9)
    assert time.time() - began < 90


def test_spans_of_named_tokens(spark):
    rnd = random.Random(11)
    draw = lambda n: "".join(rnd.choice(secrets.ALPHABETS["base64"][:62]) for _ in range(n - 2)) + "a1"
    rows = [(k, f"MYVAR={draw(44)} then {draw(42)}== end {draw(22)}={draw(22)}") for k in range(150)]
    got = secrets.digests(secrets.find_secrets(texts(spark, rows))).collect()
    found = [s for r in got for s in r.spans.split(",") if s]
    assert not any(s.startswith("random:2:") or s.startswith("random:0:") for s in found)
    first = {"random:6:50", "random:56:100"}
    assert sum(s in first for s in found) >= 0.9 * 2 * len(rows) and {(r.n_assign, r.n_access, r.n_hex) for r in got} == {(0, 0, 0)}


@pytest.mark.parametrize("length", [20, 24, 32, 48, 64, 128])
def test_randomness_battery_by_length(spark, length):
    """Random tokens have joint p-values near uniform ones at every length, and most are found among ordinary tokens."""
    rnd = random.Random(length)
    for alphabet in secrets.ALPHABETS.values():
        drawn = ["".join(rnd.choice(alphabet) for _ in range(length)) for _ in range(600)]
        drawn = [t for t in drawn if re.search("[0-9]", t) and re.search("[A-Za-z]", t)]
        p = sorted(r.p for r in spark.createDataFrame([(t,) for t in drawn], "token string").select(secrets._p_value(F.col("token")).alias("p")).collect())
        assert max(abs(x - (k + 0.5) / len(p)) for k, x in enumerate(p)) < 0.15, (length, alphabet[:3])
    words = ["config", "handler", "service", "request", "Manager", "default", "v2", "index", "item3", "test"]
    plain = [(1000 + k, "_".join(rnd.choice(words) for _ in range(40))[: length - 1] + "1") for k in range(300)]
    strong = [(k, "".join(rnd.choice(secrets.ALPHABETS["base64"][:62]) for _ in range(length - 2)) + "b2") for k in range(300)]
    got = {r.doc_id: r.spans for r in secrets.digests(secrets.find_secrets(texts(spark, plain + strong))).collect()}
    recall = sum("random" in got[d] for d, _ in strong) / len(strong)
    wrong = sum("random" in got[d] for d, _ in plain) / max(1, sum("random" in x for x in got.values()))
    assert recall >= (0.5 if length < 32 else 0.8) and wrong <= (0.3 if length < 24 else 0.15)  # short words look random too


def test_copies_do_not_move_the_cuts(spark):
    rnd = random.Random(10)
    draw = lambda: "a1" + "".join(rnd.choice(secrets.ALPHABETS["base64"]) for _ in range(42))
    tokens = [draw() for _ in range(200)]
    p = {r.token: r.p for r in spark.createDataFrame([(t,) for t in tokens], "token string").withColumn("p", secrets._step(F.col("token"))).collect()}
    rows = list(enumerate(tokens))
    alone = secrets.cuts(texts(spark, rows))
    assert set(alone.values()) == {0}
    copied = min(tokens, key=lambda t: abs(p[t] - 40))
    copies = [(1000 + k, copied) for k in range(300)]
    assert secrets.cuts(texts(spark, rows + copies)) == alone
    got = secrets.digests(secrets.find_secrets(texts(spark, rows + copies))).collect()
    assert all("random" in r.spans for r in got)


def test_chat_round_trip(spark):
    ctrl = list(chat.CONTROLS)
    rnd = random.Random(7)
    text = lambda: "".join(rnd.choice([*ctrl, "\\", " ", "x", "é🙂", "\n"]) for _ in range(rnd.randint(0, 8)))
    rows = [(c, t, rnd.choice(["user", "assistant", "assistant", "system", "tool", "[AS] x", "", None]), rnd.choice([text(), text(), None])) for c in [*range(40), None] for t in range(rnd.randint(1, 7))]
    rows += [(1, 0, "user", "tie"), (1, 0, "user", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("turns", F.lit(2))
    got = {r.conv_id: r for r in chat.parse_chats(chat.format_chats(df)).collect()}
    key = lambda r: (r[1], r[2] is not None, r[2] or "", r[3] or "")
    for c in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == c]
        said = sorted((t.role or "", t.text) for t in got[c].turns)
        assert said == sorted((r[2] or "", r[3] or "") for r in own)
        order = sorted(own, key=key)
        if len({r[1] for r in own}) == len(own):
            assert [(t.role, t.text) for t in got[c].turns] == [(r[2], r[3] or "") for r in order]
            assert got[c].loss_text == "".join(r[3] or "" for r in order if r[2] == "assistant")
    assert chat.digests(chat.format_chats(df.limit(0))).collect() == []


def test_neighbours_of_one_role_share_a_block(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(df).first().formatted == "<s>[INST] a [NEXT] b [/INST][OUT] c </s>"


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body class='has-sidebar'><header><h1>Site</h1></header><nav><a>m</a></nav>"
    "<div class=\"ad box\">buy</div><div id=plug>{plug}</div><article><header><p>by</p><h1>Ti&amp;tle</h1></header><p>One <b>two<br>three &eacute;</p><p>{body}<form>f</form><div class='share-bar'>s</div>"
    "<ul><li>i1<li>i2</ul><!-- c --><aside>x</aside><section class='comments'><article class='comment'>c1</article></section></article><footer>&copy; f</footer></body>"
)


def test_html(spark):
    rows = [(k, f"http://a.example/{k}", PAGE.format(plug="same", body=f"body {k}")) for k in range(8)]
    rows += [(50, None, None), (51, "http://b/", ""), (52, "::bad::", "plain &lt;text&gt;  here"), (53, "http://c/", "<div>" * 3000 + "deep" + "</div>" * 3000), (54, "http://c/", "<main><p>m</main> tail"), (0, "http://a.example/0", PAGE.format(plug="same", body="body 0"))]
    rows += [(60 + k, "http://t.example/", f"<body><div><span>menu of this site</span></div><div>text {k}</div>") for k in range(10)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).withColumn("host", F.lit("h")).withColumn("text", F.lit(0))
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    assert html_text.extract(df).count() == len(rows)
    assert got[3].text == "Ti&tle\n\nOne two three é\n\nbody 3\n\ni1\n\ni2" and got[3].n_chars == len(got[3].text)
    assert (got[50].text, got[51].text, got[52].text, got[53].text, got[54].text) == ("", "", "plain <text> here", "deep", "m")
    assert got[64].text == "text 4"  # the recurring menu has gone
    assert html_text.extract(df.limit(0)).collect() == []


@pytest.mark.parametrize("source, want", [
    ("<body>" + "<div>" * 197 + "<article><p>Body", ["Body"]), ("<body>" + "<div>" * 198 + "<article><p>Body", ["Body"]), ("<div>" * 50_000 + "<article><p>deep<p>er", ["deep", "er"]),
    ("<article><p title=it's>one</p><p>two</p><p>Don't</p></article>", ["one", "two", "Don't"]), ("<article><p a=\"x>y\" b='\"' c=d/e>q<br/>z</p><a href=x/>l</a></article>", ["q z", "l"]),
    ("<article><p>a <math><mi>x</mi></math> b</p><label>L</label><div class='legal-history'>LH</div><p class='share-price'>SP</p></article>", ["a x b", "L", "LH", "SP"]),
    ("<article><p class='site-footer'>f</p><div class='ad-slot-2'>a</div><div id=related_articles>r</div><section class='x comments-list'>c</section><p>t</article>", ["t"]),
    ("<article><header><div>by<h1>Head</h1><hgroup><h2>Sub</h2></hgroup></div></header><p>t</article>", ["Head", "Sub", "t"]), ("<article><p>m<!-- c --!><p>n<!--><p>o</article>", ["m", "n", "o"]),
    ("<article><script>a</scripty></script ><p>t</article>", ["t"]), ("", []), (None, []),
])
def test_html_parts(source, want):
    top = html_text.pruned(source)
    html_text._digest(top)
    assert html_text.blocks(html_text._unpack(html_text._pack(top))) == want


def test_generated_pages_lose_and_gain_nothing():
    """Pages whose text is known by construction: random blocks, inline tags, attributes and wrappers; junk around them."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefgé'漢") for _ in range(rnd.randint(1, 7)))
    attributes = lambda: rnd.choice(["", "", ' class="x y"', " id=it's", " data-a='>\"'", ' title="a>b"', " hreflang=en", ' class="story-text lead"'])
    space = lambda: rnd.choice([" ", "\n", " \t "])

    def inline(depth=0):
        said, source = [], []
        for _ in range(rnd.randint(1, 4)):
            if depth < 3 and rnd.random() < 0.3:
                tag = rnd.choice(["b", "i", "a", "span", "em"])
                words, inner = inline(depth + 1)
                said += words
                source.append(f"<{tag}{attributes()}>{inner}</{tag}>")
            else:
                w = word()
                said.append(w)
                source.append(html.escape(w) if rnd.random() < 0.5 else "".join(f"&#{ord(c)};" for c in w))
            if rnd.random() < 0.1:
                source.append(f"<!-- {word()} > -->")
        return said, space().join(source)

    def block(depth=0):
        kind = rnd.choice(["p", "h2", "blockquote", "ul", "div", "section", "table"])
        if kind in ("div", "section") and depth < 6:
            parts = [block(depth + 1) for _ in range(rnd.randint(1, 3))]
            return [b for p in parts for b in p[0]], f"<{kind}{attributes()}>{space().join(p[1] for p in parts)}</{kind}>"
        if kind == "ul":
            parts = [inline() for _ in range(rnd.randint(1, 3))]
            return [" ".join(p[0]) for p in parts], "<ul>" + "".join(f"<li{attributes()}>{p[1]}" + rnd.choice(["</li>", ""]) for p in parts) + "</ul>"
        if kind == "table":
            parts = [inline() for _ in range(4)]
            return [" ".join(p[0]) for p in parts], "<table><tr><td>{}<td>{}</tr><tr><td>{}</td><td>{}</table>".format(*(p[1] for p in parts))
        said, source = inline()
        return [" ".join(said)], f"<{kind}{attributes()}>{source}" + ("" if kind == "p" and rnd.random() < 0.3 else f"</{kind}>")

    junk = lambda: rnd.choice(["<nav><ul><li>{}</ul></nav>", "<aside>{}</aside>", "<form><label>{}</label><input value='>'></form>", "<script>if (a<b) '{}'</script>", "<div class='ad-banner'><p>{}</p></div>", "<footer>{}</footer>", "<style>{}</style>", "<div class=comments><article class=comment>{}</article></div>"]).format(word())
    for _ in range(300):
        want, source = [], []
        for _ in range(rnd.randint(1, 6)):
            blocks, said = block()
            want += blocks
            source += [said, junk() if rnd.random() < 0.4 else ""]
        wrap = rnd.randint(0, 3)
        page = f"<!doctype html><html><head><title>{word()}</title></head><body>{junk()}{'<div>' * wrap}<article{attributes()}>{''.join(source)}</article>{'</div>' * wrap}{junk()}</body></html>"
        assert html_text.blocks(html_text.pruned(page)) == want, page


def test_html_passages_that_articles_share_stay(spark):
    rows = [(k, "http://a.example/", f"<nav>n</nav><article><h1>Head</h1><p>Shared passage.</p><div class='promo2 note'>Read our app</div><p>own {k}</p></article>") for k in range(9)]
    got = [r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert sorted(got) == sorted(f"Head\n\nShared passage.\n\nown {k}" for k in range(9))


def test_html_boxes_that_recur_on_few_pages_go(spark):
    shared = "Passage that many articles of this host quote."
    rows, want = [], {}
    for k in range(200):
        own = f"Own words of article number {k}, which are more than any box of it has."
        box = f"<div class='x{k % 3}'>Offer {k % 20}</div>" + (f"<section><p>Desk {k % 40}</p></section>" if k % 2 else "")  # on 5 % and 2.5 % of the pages
        article = f"<h1>Head</h1><p>{shared}</p>{box}<p>{own}</p>"
        rows.append((k, f"http://a.example/{k}", f"<article>{article}</article>" if k % 4 else f"<body>{article}"))
        want[k] = f"Head\n\n{shared}\n\n{own}" if k % 4 else None
    body = "The same long text in several versions. " * 5
    rows += [(300 + k, "http://a.example/v", f"<article><h1>Version {k}</h1><div>{body}</div></article>") for k in range(8)]
    rows += [(400 + k, "http://a.example/c", "<article><h1>Copy</h1><p>text of the copied page</p><div>figure</div></article>") for k in range(8)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == t for k, t in want.items() if t) and not any("Offer" in t or "Desk" in t for t in got.values())
    assert all(body.strip() in got[300 + k] and "figure" in got[400 + k] for k in range(8))


def test_warc(spark):
    rows = [(3, "http://B.example.org:80/x?q=1", "same"), (1, "http://a.example.org/ü\r\nz", "same"), (2, None, None), (4, "http://a.example.org/", ""), (5, "http://a.example.org/", "é" * 50_000), (1, "again", "same"), (None, "n", "same"), (None, "n", "lone")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).withColumn("digest", F.lit("d")).withColumn("offset", F.lit(0))
    directory = warc.build_index(warc.write_pages(df))
    got = warc.find(directory, df).collect()
    first = {}
    for d, _, h in rows:
        if d is not None:
            first[h or ""] = min(d, first.get(h or "", d))
    want = []
    for d, u, h in rows:
        p = (h or "").encode()
        refers = first[h or ""] if d is not None and first[h or ""] != d else None
        want.append(str((d, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if refers is not None else "response", refers, u or "")))
    assert sorted(str(tuple(r)) for r in got) == sorted(want)
    index = warc.CaptureIndex(directory)
    assert sorted(x["page_id"] for x in index.lookup("http://A.example.org/")) == [4, 5] and index.lookup("http://none/") == []
    assert index.lookup("http://B.example.org:80/x?q=1")[0]["url"] == "http://B.example.org:80/x?q=1"
    plain = warc.find(warc.build_index(warc.write_pages(df, least_bytes=1000)), df).collect()
    assert {r.record_type for r in plain} == {"response"}
    assert warc.find(warc.build_index(warc.write_pages(df.limit(0))), df).collect() == []
    assert warc.find(directory, df.limit(0)).collect() == [] and warc.find(directory, df.filter("page_id = 4")).count() == 2


def test_warc_files_read_as_a_stream_and_name_each_record_once(spark, monkeypatch):
    monkeypatch.setattr(warc, "SLICE_BYTES", 50)
    rows = [(1, "u", "same"), (1, "u", "same"), (2, "u", "same"), (None, "u", "same"), (None, "v", "x" * 500), (3, "w", "other"), (4, "w", "other"), (5, None, None)]
    captures = warc.write_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2))
    heads = []
    for file in {r.file for r in captures.collect()}:
        data = open(file.removeprefix("file://"), "rb").read()
        while data:
            member = zlib.decompressobj(31)
            text = member.decompress(data)
            data = member.unused_data
            heads.append(dict(x.split(": ", 1) for x in text.split(b"\r\n\r\n")[0].decode().split("\r\n")[1:]))
    records = [h for h in heads if h["WARC-Type"] != "warcinfo"]
    assert len(records) == len(rows) and len({h["WARC-Record-ID"] for h in heads}) == len(heads) > len(rows)
    own = {h["WARC-Record-ID"]: h for h in records}
    referred = {h["Page-ID"]: h.get("WARC-Refers-To") for h in records if h["WARC-Type"] == "revisit"}
    assert referred["2"] is None and own[referred["4"]]["Page-ID"] == "3" and set(referred) == {"2", "4"}

def test_warc_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    df = spark.range(50).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.example/"), F.col("id") % 7).alias("url"), F.concat(F.lit("page "), "id").alias("html"))
    directory = warc.build_index(warc.write_pages(df))
    assert sum(r.blocks for r in directory.collect()) >= 16
    found = warc.find(directory, df)
    assert sorted(r.page_id for r in found.collect()) == list(range(50))
    assert sorted(x["page_id"] for x in warc.CaptureIndex(directory).lookup("http://h.example/3")) == list(range(3, 50, 7))


def test_decontamination(spark, odd, monkeypatch):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(rnd.choice([5, 9, 12, 30, 50])))) for k in range(30)]
    bench = [*items, (90, None), (91, ""), (None, "no id here at all")]
    docs, truth = [], set()
    for k, (i, t) in enumerate(items):
        w = t.split()
        fill = [word() for _ in range(60)]
        near = list(w)
        for at in rnd.sample(range(len(near)), len(near) // 7):
            near[at] = word()
        docs.append((1000 + k, " ".join([*fill[:20], *(x.upper() + "," for x in near), *fill[20:]])))
        truth.add((1000 + k, i))
        docs.append((2000 + k, " ".join([*fill, *w[: len(w) // 3], *fill])))
        docs.append((3000 + k, t))
        truth.add((3000 + k, i))
    rows = [*odd, *docs]
    frame = spark.createDataFrame(bench, "item_id long, text string").withColumn("doc_id", F.lit(1))
    for seeds in (decontam.SEEDS_AT_ONCE, 50):
        monkeypatch.setattr(decontam, "SEEDS_AT_ONCE", seeds)
        got = {(r.doc_id, r.item_id) for r in decontam.overlaps(texts(spark, rows), frame).collect()}
        assert got == truth
    left = decontam.clean(texts(spark, rows), frame)
    assert left.columns == texts(spark, rows).columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(d) for d, _ in rows if d not in {x for x, _ in truth})
    assert decontam.overlaps(texts(spark, rows), frame.limit(0)).collect() == [] and decontam.clean(texts(spark, rows).limit(0), frame).collect() == []


@pytest.mark.parametrize("n", range(8, 25))
def test_masks_hit_every_placement_of_substitutions(n):
    most = n - -(-3 * n // 4)
    equal = np.array([(1 << n) - 1 - sum(1 << k for k in gone) for gone in itertools.combinations(range(n), most)])
    hit = np.zeros(len(equal), bool)
    for places in decontam._masks(n):
        for at in range(n - int(places[-1])):
            seed = sum(1 << int(k + at) for k in places)
            hit |= equal & seed == seed
    assert hit.all()


def judged(items, docs):
    """(text, item) of the overlaps of texts that share a batch."""
    words = lambda rows: decontam.texts.words(pa.array(rows, pa.string()), lower=True, marks=True)
    block = decontam.Items(list(range(len(items))), [words([x]).hashes for x in items])
    return [r[:2] for r in decontam._judge(block, words(docs))]


def test_periodic_substitutions_are_found():
    for n in (8, 12, 20, 24, 60, 500):
        item = [f"w{k}" for k in range(n)]
        for period, phase in [(p, f) for p in (4, 5) for f in range(p)]:
            near = [f"x{k}" if k % period == phase else w for k, w in enumerate(item)]
            equal = sum(a == b for a, b in zip(item, near, strict=True))
            assert judged([" ".join(item)], ["before it", " ".join(near), "after it"]) == ([(1, 0)] if equal >= 0.75 * n or n > 24 else [])


def windows_that_agree(item, doc):
    """Whether some window of the item is in the document, by comparing all of them on all diagonals."""
    n = min(len(item), decontam.WINDOW)
    need = n if len(item) < decontam.WHOLE else -(-3 * n // 4)
    for d in range(1 - len(item), len(doc)):
        equal = [0 <= d + k < len(doc) and doc[d + k] == w for k, w in enumerate(item)]
        if any(sum(equal[k : k + n]) >= need for k in range(len(item) - n + 1)):
            return True
    return False


@pytest.mark.parametrize("n", [1, 4, 5, 6, 7, 8, 9, 11, 13, 16, 19, 20, 23, 24, 25, 31, 40, 60])
def test_overlaps_equal_all_windows_at_the_limit(n):
    rnd = random.Random(n)
    items, docs = [], []
    for _ in range(40):
        item = [f"i{rnd.randrange(10**6)}" for _ in range(n)]
        near, at, width = list(item), rnd.randint(0, n - min(n, 24)), min(n, 24)
        for k in rnd.sample(range(at, at + width), rnd.choice([width // 4, width // 4, width // 4 + 1])):
            near[k] = "x"
        for k in (k for k in range(n) if not at <= k < at + width):
            near[k] = item[k] if rnd.random() < 0.5 else "y"
        items.append(item)
        docs.append([f"a{rnd.randrange(50)}" for _ in range(rnd.randint(0, 30))] + near + ["b"] * rnd.randint(0, 3))
    want = {(t, i) for t, d in enumerate(docs) for i, x in enumerate(items) if windows_that_agree(x, d)}
    assert set(judged([" ".join(x) for x in items], [" ".join(d) for d in docs])) == want


def test_an_inner_excerpt_is_found_in_its_own_text():
    for n, length, inner in ((120, 55, 24), (200, 80, 40), (400, 150, 100)):
        item = [f"w{k}" for k in range(n)]
        for begin in range(0, n - inner + 1, 7):
            for before in range(0, length - inner + 1, 6):
                doc = [*(f"x{k}" for k in range(before)), *item[begin : begin + inner], *(f"y{k}" for k in range(length - inner - before))]
                assert judged([" ".join(item)], ["one text", " ".join(doc), "", " ".join(f"z{k}" for k in range(300))]) == [(1, 0)]
                assert judged([" ".join(item)], [" ".join(doc)]) == [(0, 0)]


def test_html_unclosed_parts(spark):
    pages = ["<head><title>T</title><style>x{}</style><body><p>a", "<title>T</title><p>b</p>", "<nav><ul><li>m<article><p>c</article>", "<article><p>d <b>e<p>f &am", "<article><p>g<b", "<article><div class='header'><h2 class=x>H</h2>by</div><p>i</p></article>"]
    df = spark.createDataFrame([(k, "u", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    assert [r.text for r in html_text.extract(df).orderBy("page_id").collect()] == ["a", "b", "c", "d e\n\nf &am", "g", "H\n\ni"]


def test_character_references_are_decoded_once(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>&amp;lt; &#x41;&nbsp;b</p></article>")], "page_id long, url string, html string")
    assert html_text.extract(df).first().text == html.unescape("&amp;lt; A b").replace(" ", " ")
