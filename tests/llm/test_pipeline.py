"""The corpus pipeline, stage by stage, against what each stage must do to its input."""

import numpy as np
import pandas as pd
import pytest

from letterloom.llm import neardup, quality, simhash
from letterloom.llm import pipeline as corpus_pipeline
from tests.llm.test_operators import slow_contamination, slow_fingerprint, slow_line_dedup


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    root = tmp_path_factory.mktemp("stages")
    frames = [pd.read_parquet(f"{sf_dir}/documents.parquet")]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{n}")
        docs = spark.read.parquet(f"{root}/{n}")
        frames.append(docs.toPandas())
    return frames


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "mixing"]
    assert all(list(f.columns) == list(stages[0].columns) for f in stages[:-1]) and "rate" in stages[-1].columns
    assert all(f.doc_id.is_unique for f in stages)


def test_quality_stage(spark, sf_dir, stages):
    before, after = stages[0], stages[1]
    net = quality.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = before[net.score([t.encode() for t in before.text]) >= quality.THRESHOLD]
    assert set(after.doc_id) == set(good.doc_id) and len(after) < len(before)


def test_line_stage(stages):
    before, after = stages[1].sort_values("doc_id"), stages[2].set_index("doc_id")
    gone = slow_line_dedup(zip(before.doc_id, before.text))
    texts = before.set_index("doc_id").text
    assert all((after.text.get(i) == texts[i]) == (n == 0) for i, n in gone.items())
    assert (after.n_chars == after.text.str.len()).all()


def test_near_duplicate_stage(stages):
    before, after = stages[2], set(stages[3].doc_id)
    fps = {i: slow_fingerprint(t) for i, t in zip(before.doc_id, before.text)}
    kept = [fps[i] for i in after]
    assert all((a ^ b).bit_count() > simhash.RADIUS for n, a in enumerate(kept) for b in kept[:n])
    ids, near = sorted(fps), {i: i for i in fps}

    def find(i):
        while near[i] != i:
            i = near[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (fps[i] ^ fps[j]).bit_count() <= simhash.RADIUS:
                a, b = find(i), find(j)
                near[max(a, b)] = min(a, b)
    assert after == {i for i in ids if find(i) == i}


def test_decontamination_stage(sf_dir, stages):
    before, after = stages[3], set(stages[4].doc_id)
    bench = pd.read_parquet(f"{sf_dir}/benchmark.parquet")
    found = slow_contamination(zip(before.doc_id, before.text), zip(bench.item_id, bench.text))
    assert after == {i for i, v in found.items() if v[2] < corpus_pipeline.LEAKED_ITEMS}


def test_run_equals_stages(spark, sf_dir, stages):
    out = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert set(out.doc_id) == set(stages[-1].doc_id) == set(stages[-2].doc_id)
    both = out.merge(stages[-1], on="doc_id")
    assert (both.rate_x - both.rate_y).abs().max() < 1e-9 and (both.n_copies_x == both.n_copies_y).all()


def slow_similar(rows, words=5, least=0.8):
    """The smallest id of each group of texts linked by the Jaccard similarity of their shingle sets, all pairs compared."""
    rows = sorted(rows)
    sets, number = [], {}
    for _, text in rows:
        w = text.lower().split()
        sets.append({number.setdefault(tuple(w[i : i + words]), len(number)) for i in range(max(1, len(w) - words + 1))} if w else set())
    near = list(range(len(rows)))
    pairs = 0
    for n, a in enumerate(sets):
        for m in range(n):
            both = len(a & sets[m])
            if both >= least * (len(a) + len(sets[m]) - both):
                pairs += rows[n][1] != rows[m][1]
                near = [near[m] if x == near[n] else x for x in near] if near[m] < near[n] else [near[n] if x == near[m] else x for x in near]
    return {rows[i][0] for i, x in enumerate(near) if x == i}, pairs


def test_near_duplicate_stage_by_similarity(spark):
    """Raw texts, before line dedup, and made copies with a few words changed: most differ in more bits than op1's radius."""
    rng = np.random.default_rng(4)
    raw = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")[["doc_id", "text"]]
    rows = [(int(i), t) for i, t in zip(raw.doc_id, raw.text)][:700]
    words = [f"w{i}" for i in range(3000)]
    for n in range(40):
        base = rng.choice(words, 60 + 10 * n)
        rows.append((10_000 + 10 * n, " ".join(base)))
        for k in range(1, 5):
            copy = base.copy()
            copy[rng.choice(len(base), max(1, len(base) * k // 100), replace=False)] = "changed"
            rows.append((10_000 + 10 * n + k, " ".join(copy)))
    want, pairs = slow_similar(rows)
    assert pairs > 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()} == want
    far = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert far != want
    assert {r.doc_id for r in neardup.keep_one_similar(docs, shard_rows=2).collect()} == want


def test_stages_odd(spark, sf_dir):
    """Null ids and texts, empties, repeated rows and columns with the stages' own names, and an empty table."""
    names = "_key _id _spans _deleted_lines _emptied deleted_lines emptied key_a _key_a times _shares _tokens _rate rate n_tokens p_clean".split()
    texts = [(1, None), (2, ""), (3, "One two three four five six."), (3, "One two three four five six."), (None, "Words of no id here."), (None, None), (4, "Plain words of an ordinary text. " * 30)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, *([5] * len(names))) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
        if name == "mixing":
            assert len(rows) == 7 and {"rate", "n_tokens", "p_clean", "n_copies"} <= set(out.columns) and len(out.columns) == len({c.lower() for c in out.columns})
            continue
        assert out.columns == docs.columns and all(r[c] == 5 for r in rows for c in names), name
        if name != "quality_classifier":
            assert len(rows) == {"line_dedup": 7, "simhash_near_dedup": 4, "benchmark_decontamination": 7}[name]


def test_the_script_has_the_stages():
    import corpus_pipeline as script

    assert script.STAGES is corpus_pipeline.STAGES and script.run is corpus_pipeline.run and script.ORACLE_SQL is None


def test_near_duplicate_stage_odd(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (4, "One two"), (5, "one  two"), (None, "one two"), (None, "else"), (6, "one two three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r.doc_id or 0), r.text or "") for r in neardup.keep_one_similar(docs).collect())
    assert found == [(0, "else"), (1, ""), (4, "One two"), (6, "one two three")]
    assert neardup.keep_one_similar(docs.limit(0)).count() == 0


def test_near_duplicate_candidates_are_fingerprints(spark):
    """Links come of fingerprints alone: those that share a byte and lie within the radius, all pairs compared; none similar is lost."""
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 2, 2, 3, 4, 4, 5, 8, 30, 30, 200, 900)]
    for base in sets[4:]:
        for lost in (len(base) // 10, len(base) // 9, len(base) // 6, len(base) // 2):
            fresh = rng.integers(0, 1 << 63, max(1, lost), dtype=np.uint64)
            sets += [np.union1d(base[lost:], fresh[: lost or 1]), np.union1d(base, fresh)]
    words = neardup.words_of(0.8)
    fps = [neardup.fingerprint(s, words) for s in sets]
    bits = [np.unpackbits(np.frombuffer(f, np.uint8)) for f in fps]
    half, full = neardup.radius_of(0.8, 128), neardup.radius_of(0.8, 256)
    near = {f[:32]: f[:32] for f in fps}
    similar = 0
    for i in range(len(sets)):
        for j in range(i):
            fits = min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j]))
            shared = any(x == y for x, y in zip(fps[i], fps[j]))
            linked = fits and shared and (bits[i] != bits[j])[:128].sum() <= half and (bits[i] != bits[j])[:256].sum() <= full
            if neardup.similarity(sets[i], sets[j]) >= 0.8:
                similar += 1
                assert linked
            if linked:
                a, b = near[fps[i][:32]], near[fps[j][:32]]
                near = {k: min(a, b) if v in (a, b) else v for k, v in near.items()}
    assert similar > 20 and len(set(near.values())) > 5
    nodes = spark.createDataFrame([(bytearray(f), len(s)) for f, s in zip(fps, sets)], "fp binary, n int").repartition(3)
    for rows in (4, 1 << 16):  # with buckets cut into shards and without
        stars = neardup.connected_components(neardup.near_fingerprints(nodes, tile_rows=rows)).collect()
        assert {bytes(r.node): bytes(r.root) for r in stars} == {k: v for k, v in near.items() if list(near.values()).count(v) > 1}


def test_near_duplicate_fingerprint():
    """Bits by plain counting, and the chance that one differs at a similarity of 0.8: 3/16 for four hashes against five, the largest."""
    rng = np.random.default_rng(6)
    words, mask = 2, (1 << 64) - 1
    for n in (1, 2, 3, 4, 300):
        hashes = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        want = b""
        for w in range(1, words + 1):
            mixed = []
            for h in hashes.tolist():
                z = (h + w * 0x9E3779B97F4A7C15) & mask
                z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
                z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
                mixed.append("".join(f"{b:08b}" for b in (z ^ (z >> 31)).to_bytes(8, "little")))
            ones = [sum(m[b] == "1" for m in mixed) for b in range(64)]
            bits = "".join(mixed[0][b] if 2 * c == n else str(int(2 * c > n)) for b, c in enumerate(ones))
            want += int(bits, 2).to_bytes(8, "big")
        assert neardup.fingerprint(hashes, words) == want
    assert neardup.fingerprint(np.empty(0, np.uint64), words) == bytes(16)
    bits = 64 * neardup.words_of(0.8)
    assert abs(neardup.apart(0.8) - 3 / 16) < 1e-12 and bits == 640
    for both, a, b in ((4, 0, 1), (8, 1, 1), (8, 0, 2), (12, 0, 3), (40, 5, 5), (200, 25, 25)):
        differ = []
        for _ in range(200):
            hashes = rng.integers(0, 1 << 63, both + a + b, dtype=np.uint64)
            x, y = (np.frombuffer(neardup.fingerprint(np.sort(h), bits // 64), np.uint8) for h in (hashes[: both + a], np.delete(hashes, np.s_[both : both + a])))
            assert (x == y).any()
            differ.append(np.bitwise_count(x ^ y).sum() / bits)
        assert np.mean(differ) < neardup.apart(0.8) + 0.004, (both, a, b)
