"""BPE, packing, token counts, host rules, the classifier and preference formatting."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sketchfield.llm import packing, preference_format, quality_fm, quality_rules, queries, token_counts, word_bpe


def test_bpe_equals_the_library(tokenizer):
    tokenizers = pytest.importorskip("tokenizers")
    theirs, ours = tokenizers.Tokenizer.from_file(str(tokenizer)), word_bpe.WordBpe(str(tokenizer))
    random.seed(5)
    pool = list("aAbBthingreone 's't \t\n\x1c\x85\xa0​　éÉñßΣσςİıÅ中文字123٣½!?#…—😀") + ["<|endoftext|>", "</w>", "don't", "ΑΣ", "thth", "a" * 70]
    texts = ["", " ", "x" * 5_000] + ["".join(random.choices(pool, k=random.randint(1, 60))) for _ in range(1_500)]
    for text, raw in zip(texts, ours.encode(texts)):
        ids = np.frombuffer(raw, "<u4")
        want = theirs.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text
        assert ours.decode(ids) == theirs.decode(want, skip_special_tokens=False)
    assert 0 < ours.merged < ours.proposed


def test_bpe_equals_the_library_on_every_code_point(tokenizer):
    tokenizers = pytest.importorskip("tokenizers")
    theirs, ours = tokenizers.Tokenizer.from_file(str(tokenizer)), word_bpe.WordBpe(str(tokenizer))
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{chr(c)}B {chr(c)}" for c in points[a : a + 200]) for a in range(0, len(points), 200)]
    texts += [f"a{chr(c)}B {chr(c)}\u0301" for c in [*range(0x80, 0x3100), 0x1C89, 0xA7CC, 0xA7CE, 0x105C0, 0x105D2, 0x11382]]
    for a in range(0, len(texts), 500):
        want = [x.ids for x in theirs.encode_batch(texts[a : a + 500], add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in ours.encode(texts[a : a + 500])] == want


def test_bpe_column_of_odd_rows(spark, odd, none, tokenizer):
    got = word_bpe.digests(odd, tokenizer).collect()
    assert len(got) == odd.count() and {r["n_tokens"] for r in got if r["doc_id"] in (3, 4, 5)} == {0}
    ids = word_bpe.encode_column(odd, tokenizer).where("doc_id = 8").first()
    assert len(ids["ids"]) == 1 and ids["decoded"] == "x</w>"
    assert word_bpe.digests(none, tokenizer).count() == 0


def test_bpe_of_odd_rows_equals_the_library(odd, tokenizer):
    tokenizers = pytest.importorskip("tokenizers")
    theirs = tokenizers.Tokenizer.from_file(str(tokenizer))
    want = []
    for r in odd.collect():
        ids = theirs.encode(r["text"] or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(theirs.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, word_bpe.digests(odd, tokenizer).collect()), key=repr) == sorted(want, key=repr)


def test_counts_and_rules_ignore_clashing_columns(odd, tokenizer):
    clashing = odd.withColumnsRenamed({"kept": "n_tokens", "spans": "n_docs", "s": "block", "words": "hosts", "t": "rejected", "score": "host"})
    counts = lambda df: sorted(map(tuple, token_counts.token_counts(df, tokenizer).collect()))
    assert counts(clashing) == counts(odd.select("text"))
    rules = lambda df: sorted(map(tuple, quality_rules.verdicts(df).collect()), key=repr)
    assert rules(clashing) == rules(odd.select("doc_id", "text", "source"))
    kept = quality_rules.kept_documents(clashing)
    assert kept.columns == clashing.columns and kept.count() == quality_rules.kept_documents(odd).count()


def test_training_rows_of_a_repeated_id(spark):
    texts = {i: ["good words here " * 9, "bad | stuff # " * 9][i % 2] for i in range(40)}
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in texts], "doc_id long, quality int")
    rows = [(i, t, len(t)) for i, t in texts.items()] + [(i, "another text of this id", 23) for i in range(0, 40, 3)]
    found = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, n_chars long").repartition(3)
        found.append([(a.tolist(), x.tolist(), y) for a, x, y in quality_fm.training_rows(docs, labels)])
    assert found[0] == found[1] and len(found[0]) > 20


def test_best_fit_against_a_plain_search():
    random.seed(2)
    fit, free, closed = packing.BestFit(50, 4), {}, set()
    for _ in range(500):
        n = random.randint(1, 50)
        fitting = [(f, -age, b) for b, (f, age) in free.items() if f >= n]
        where, at = fit.place(n)
        if fitting:
            least = min(f for f, _, _ in fitting)
            assert free[where][0] == least and at == 50 - least
            left = least - n
            del free[where]
        else:
            assert at == 0 and where not in closed
            left = 50 - n
        if left:
            if len(free) == 4:
                least = min(f for f, _ in free.values())
                gone = next(b for b, (f, _) in sorted(free.items(), key=lambda x: x[1][1]) if f == least)
                closed.add(gone)
                del free[gone]
            free[where] = (left, _)
            free = {b: (f, age) for b, (f, age) in free.items()}
        assert len(free) <= 4


def _packing_is_sound(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(by)


def test_packing_whole_documents(spark, data, odd, none, tokenizer):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = packing.packed(docs, tokenizer, with_ids=True).collect()
    used = _packing_is_sound(rows, 2048)
    total = sum(r["length"] for r in rows)
    assert used <= 1.05 * -(-total // 2048) + 1
    bpe = word_bpe.load(tokenizer)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    whole = defaultdict(dict)
    for r in rows:
        whole[r["doc_id"]][r["piece"]] = r
    assert whole.keys() == texts.keys()
    for i, text in texts.items():
        ids = [*np.frombuffer(bpe.encode([text])[0], "<u4").tolist(), 0]
        own = [whole[i][k] for k in sorted(whole[i])]
        assert [x for r in own for x in r["ids"]] == ids
        assert all(r["length"] == 2048 for r in own[:-1]) and [r["start"] for r in own] == list(range(0, len(ids), 2048))
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in own)
    odd_rows = packing.packed(odd, tokenizer, rows_per_task=3).collect()
    _packing_is_sound(odd_rows, 2048)
    assert {r["length"] for r in odd_rows if r["doc_id"] in (3, 4, 5)} == {1}
    assert len([r for r in odd_rows if r["doc_id"] == 2]) == 2 and packing.packed(none, tokenizer).count() == 0


def test_token_counts_against_brute_force(spark, data, odd, none, tokenizer):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("text").union(odd.select("text"))
    bpe = word_bpe.load(tokenizer)
    n = [len(x) // 4 for x in bpe.encode([r["text"] or "" for r in docs.collect()])]
    rows = token_counts.token_counts(docs, tokenizer).collect()
    assert {r["n_tokens"]: r["n_docs"] for r in rows} == Counter(n)
    for r in rows:
        limit = r["n_tokens"]
        assert r["truncated_total"] == sum(min(x, limit) for x in n) and r["docs_fitting"] == sum(x <= limit for x in n)
        assert r["docs_at_least"] == sum(x >= limit for x in n) and r["tokens_at_least"] == sum(x for x in n if x >= limit)
    limits = token_counts.at_limits(token_counts.token_counts(docs, tokenizer), [0, 100, 10**9]).collect()
    assert {r["context_limit"]: r["truncated_total"] for r in limits} == {k: sum(min(x, k) for x in n) for k in (0, 100, 10**9)}
    assert token_counts.token_counts(none, tokenizer).count() == 0


def _rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rules_against_brute_force(spark, data, odd, none):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "source").union(odd.select("doc_id", "text", "source"))
    got = quality_rules.verdicts(docs).collect()
    texts = defaultdict(set)
    for r in docs.collect():
        texts[r["doc_id"]].add(_rules(r["text"] or ""))
    assert len(got) == docs.count()
    for r in got:
        own = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert own in texts[r["doc_id"]]
        assert r["base_failed"] == (own[0] < 20 or 100 * own[4] > 30 * own[0])
    assert quality_rules.verdicts(none).count() == 0 and quality_rules.kept_documents(none).count() == 0
    kept = quality_rules.kept_documents(odd)
    assert kept.columns == odd.columns and kept.where("doc_id in (3, 4, 5, 8)").count() == 0


def test_hosts_that_fail_are_rejected_whole(spark):
    good, bad = " ".join(f"word{i}" for i in range(40)), "a b"
    rows = [(i, good if i % 10 or h == "fine" else bad, h) for h in ("fine", "good") for i in range(60)] + [(100 + i, bad if i % 10 else good, "awful") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = quality_rules.verdicts(docs).where("not base_failed").collect()
    assert {r["kept"] for r in got if r["doc_id"] >= 100} == {False} and {r["kept"] for r in got if r["doc_id"] < 100} == {True}
    assert {r["source"] for r in quality_rules.kept_documents(docs).collect()} == {"fine", "good"}


def test_pairs_in_linear_time():
    fm = quality_fm.FactorisationMachine(20, 3)
    fm.v = np.random.default_rng(1).normal(size=(20, 3)).astype(np.float32)
    at, x = np.array([1, 4, 9, 15]), np.array([0.5, 1, 2, -1], np.float32)
    plain = sum(float(fm.v[at[i]] @ fm.v[at[j]]) * x[i] * x[j] for i in range(4) for j in range(i))
    assert abs(fm.scores([(at, x)])[0] - 1 / (1 + np.exp(-plain))) < 1e-5


def test_classifier_on_held_out_labels(spark, data, odd, none):
    folder = data.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_fm.scored(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", "quality", "score").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.9
    bad, good = ([r["score"] for r in got if r["quality"] == q] for q in (0, 1))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    rows = quality_fm.scored(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows) and all(r["held_out"] for r in rows if r["doc_id"] is None)
    assert {r["score"] for r in quality_fm.scored(odd, labels.limit(0)).collect()} == {0.5}
    assert quality_fm.scored(none, labels).count() == 0
    kept = quality_fm.kept_documents(odd, labels.limit(0))
    assert kept.schema == odd.schema and kept.count() == odd.count()


def test_labels_are_held_out_by_crc(spark):
    got = spark.range(200).select("id", quality_fm.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)


def test_preferences_share_a_prompt_once(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", "bye"), (1, 0, "user", "x"), (1, 1, "assistant", "no"), (2, 0, "user", None), (2, 1, "assistant", "alone"), (3, 0, "user", "none"), (None, 0, "user", "lost"), (4, None, "user", "lost")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in preference_format.preference_format(turns).collect()}
    assert got.keys() == {0, 1, 2, 3}
    assert tuple(got[3])[1:] == (1, "<|user|>\nnone\n", "", "", "", "")
    r = got[0]
    assert r["prompt"] == "<|user|>\nhi\n" and r["chosen"] == "<|assistant|>\nyes\n<|user|>\nbye\n" and r["rejected"] == "<|assistant|>\nno\n<|user|>\nbye\n"
    a, z = map(int, r["rejected_mask"].split(":"))
    assert r["rejected"][a:z] == "no"
    assert got[2]["rejected"] == "" and got[2]["rejected_mask"] == "" and got[2]["prompt"] == "<|user|>\n\n"
    assert preference_format.preference_format(turns.limit(0)).count() == 0
    equal = preference_format.conversations(turns.where("conv_id = 0")).select("conv_id", F.col("turns").alias("chosen"), F.col("turns").alias("rejected"))
    same = preference_format.formatted(equal).first()
    assert same["prompt_turns"] == 3 and same["chosen"] == same["rejected"] == ""


def test_conversations_without_a_reply_are_all_prompt(spark, data):
    turns = spark.read.parquet(f"{data}/conversations.parquet")
    said = {}
    for r in turns.where("conv_id is not null and turn is not null").collect():
        said.setdefault(r["conv_id"], set()).add(r["role"])
    got = {r["conv_id"]: r for r in queries.QUERIES["op4_preference_format"](spark, data).collect()}
    mute = {i for i, roles in said.items() if "assistant" not in roles}
    assert got.keys() == said.keys() and len(mute) == 4
    assert mute == {i for i, r in got.items() if r["chosen"] == r["rejected"] == "" and "<|assistant|>" not in r["prompt"]}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    result = con.execute(queries.SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(map(tuple, queries.QUERIES[name](spark, data).select(*columns).collect()), key=repr) == sorted(result.fetchall(), key=repr)


def _plain_preferences(rows):
    """By plain lists of turns."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None and turn is not None:
            convs[c].append((turn, role or "", text or ""))
    last = {c: max((i for i, t in enumerate(sorted(ts)) if t[1] == "assistant"), default=None) for c, ts in convs.items()}
    out = {}
    for c, ts in convs.items():
        chosen, at, other = sorted(ts), last[c], last.get(c ^ 1)
        rejected = list(chosen)
        if at is not None:
            rejected[at : at + 1] = [] if other is None else [(*chosen[at][:2], sorted(convs[c ^ 1])[other][2])]
        n = 0
        while n < min(len(chosen), len(rejected)) and chosen[n][1:] == rejected[n][1:]:
            n += 1

        def side(turns):
            text, spans = "", []
            for _, role, own in turns:
                text += f"<|{role}|>\n"
                if role == "assistant":
                    spans.append(f"{len(text)}:{len(text) + len(own)}")
                text += own + "\n"
            return text, ",".join(spans)

        (a, x), (b, y) = side(chosen[n:]), side(rejected[n:])
        out[c] = (c, n, side(chosen[:n])[0], a, b, x, y)
    return out


def test_preferences_against_plain_lists(spark, data):
    """Ties, repeated rows, nulls, long texts, ids with a fraction, an empty table, and columns whose names the operator uses."""
    table = spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = [tuple(r) for r in table.collect()]
    rows += [(900_000, 0, "user", "long " * 50_000), (900_000, 1, "assistant", "x" * 200_000), (900_001, 0, "user", "long " * 50_000), (900_001, 1, "assistant", "y")]
    rows += [(900_010, 1, "assistant", "b"), (900_010, 1, "assistant", "a"), (900_010, 1, "assistant", "b"), (900_011, 5, None, None), (900_011, 6, "assistant", None), (-4, 0, "user", "u"), (-3, 0, "assistant", "v"), (None, 1, "user", "w"), (900_012, None, "user", "w")]
    frame = spark.createDataFrame([(*r, 1, "z", None, 0.5) for r in rows], "conv_id long, turn long, role string, text string, pair int, c string, `all` string, t double")
    got = {r["conv_id"]: tuple(r) for r in preference_format.preference_format(frame).collect()}
    assert got == _plain_preferences(rows)
    assert preference_format.preference_format(frame.limit(0)).count() == 0
    fractions = spark.createDataFrame([(1.5, 0, "user", "a"), (2.0, 0, "user", "b")], "conv_id double, turn long, role string, text string")
    assert [r["conv_id"] for r in preference_format.preference_format(fractions).collect()] == [2]


def test_host_verdicts_against_sql(spark, tmp_path):
    """On a table where hosts are rejected, one of them by each rule."""
    good = " ".join(f"word{i}" for i in range(40))
    bad = {"short": "a b", "repeats": "one two three four five six seven eight " * 5, "symbols": "## || ** " * 8 + " ".join(f"x{i}" for i in range(20)), "lines": "\n".join(["a line that is there again " + str(i % 3) for i in range(30)]) + good}
    random.seed(9)
    rows, i = [], 0
    for host, share in [*((h, 0.8) for h in bad), *((f"fine{k}", 0.02) for k in range(30)), ("border", 0.3), ("tiny", 1.0), (None, 0.1)]:
        for _ in range(2 if host == "tiny" else 200):
            kind = host if host in bad else random.choice(list(bad))
            rows.append((i, bad[kind] if random.random() < share else good, host))
            i += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    got = quality_rules.verdicts(docs)
    columns = sorted(got.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({queries.OP9_SQL})").fetchall())
    lost = {rows[r["doc_id"]][2] for r in got.where("not kept and not base_failed").collect()}
    assert lost == set(bad)
    assert {r["doc_id"] for r in quality_rules.kept_documents(docs).collect()} == {r["doc_id"] for r in got.where("kept").collect()}


def test_packing_bound_and_lookahead(spark):
    random.seed(12)
    lengths = [random.choice((2048, random.randint(1, 2048), random.randint(1, 300))) for _ in range(9_000)]
    found = spark.createDataFrame([(i, 0, 0, n, i % 7) for i, n in enumerate(lengths)], packing.PIECES)
    least = -(-sum(lengths) // 2048)
    used = {}
    for bins, ahead in ((1024, 4096), (64, 4096), (64, 1)):
        rows = packing.best_fit(found, 1, open_bins=bins, lookahead=ahead).collect()
        assert sorted(r["length"] for r in rows) == sorted(lengths)
        used[bins, ahead] = _packing_is_sound(rows, 2048)
    assert least <= used[1024, 4096] <= 1.005 * least and used[64, 1] <= 1.05 * least and used[64, 4096] > used[1024, 4096]


def test_packing_deals_null_ids_evenly(spark, tokenizer):
    docs = spark.range(4_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "'same' AS text")
    rows = packing.packed(docs, tokenizer, rows_per_task=500).groupBy(F.expr("sequence_id >> 40")).count().collect()
    assert len(rows) == 8 and max(r["count"] for r in rows) < 1_000
