"""Each operator against brute force, the libraries or exact round trips, with odd rows."""

import base64
import hashlib
import html
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from docloom.llm import byte_bpe, common, html_extract, media, mixing, near_dedup, ngram_lm, quality_rules, sharding, token_counts, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, size string, row string"
WORD = r"[^\x20\x09-\x0D]+"
BASE = "the quick brown fox jumps over the lazy dog and runs far away from all of the other animals in this old green wood by the river"


def odd_texts():
    words = BASE.split()
    near = [" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in range(5)]
    texts = [BASE, BASE, BASE.upper(), *near, None, "", "   \n\t", "one", "one", "ONE two", "é漢😀 " * 50, "a" * 3000, "x  y\n\n z ", "<|endoftext|> <s>", "word " * 400, "!!" * 40]
    return texts + [f"text number {i} " + " ".join(words[i % 9 :] * (1 + i % 4)) + f" {i * 7919}" for i in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], None if i % 7 == 0 else f"s{i % 4 if i % 2 else 0}", len(t or ""), "clash", "clash", "clash") for i, t in enumerate(odd_texts())]
    return spark.createDataFrame(rows + [rows[0]], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_shards_are_even_and_gapless(docs, nothing):
    rows = sharding.shards(docs, 4).collect()
    assert len(rows) == docs.count() and sharding.shards(nothing, 4).count() == 0
    slots, sizes, texts = defaultdict(list), Counter(), texts_of(docs)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in rows)


def test_mix_meets_targets(docs, nothing):
    rows, sources = mixing.mix(docs, block=8).collect(), {r.doc_id: r.source for r in docs.collect()}
    assert len(rows) == docs.count() and mixing.mix(nothing).count() == 0
    texts, taken, sizes, targets = texts_of(docs), Counter(), Counter(), {}
    for r in rows:
        assert r.size == len(re.findall(WORD, texts[r.doc_id] or "")) and r.taken <= 2 * r.size
        taken[sources[r.doc_id]] += r.taken
        sizes[sources[r.doc_id]] += r.size
        targets[sources[r.doc_id]] = r.target
    assert all(abs(taken[s] - targets[s]) <= 0.5 for s in sizes)
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), [5, 2, 1] * 9))
    want, open_ = {}, set(sizes)
    while True:
        left = 1.5 * sum(sizes.values()) - sum(want.values())
        rate = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if rate * weights[s] > 2 * sizes[s]}
        if not full:
            break
        want |= {s: 2.0 * sizes[s] for s in full}
        open_ -= full
    want |= {s: rate * weights[s] for s in open_}
    assert all(abs(want[s] - targets[s]) < 1e-6 for s in sizes)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs, block=8).collect()))


def test_mix_goes_to_the_shards_drawn(docs):
    got, want = Counter(), Counter()
    sources = {r.doc_id: r.source for r in docs.collect()}
    for r in mixing.mix(docs, block=8).collect():
        assert sum(s.words for s in r.shards) == r.taken and len({s.shard for s in r.shards}) == len(r.shards)
        for s in r.shards:
            got[sources[r.doc_id], s.shard] += s.words
    goals = mixing.targets(mixing.sized(docs))
    names = {r.sid: r.source for r in goals.collect()}
    for r in mixing.slots(goals, 8).collect():
        want[names[r.sid], r.shard] += r.words
    assert got == want and len({s for _, s in got}) > 20


def test_permutations_are_bijections(spark):
    for n in (1, 2, 7, 100):
        size, sid, epoch = (F.lit(k).cast("long") for k in (n, 3, 1))
        got = spark.range(n).select(mixing.permuted(F.col("id"), size, mixing.round_keys(sid, epoch, size))).collect()
        assert sorted(r[0] for r in got) == list(range(n))


def test_mixed_documents_hold_the_words_taken(docs):
    taken = Counter()
    for r in mixing.mixed_documents(docs, block=8).collect():
        taken[r.doc_id] += len(re.findall(WORD, r.text))
    want = Counter()
    for r in mixing.mix(docs, block=8).collect():
        want[r.doc_id] += r.taken
    assert +taken == +want


def test_token_counts_match_the_library(docs, nothing, tmp_path):
    path = P.path("piece_bpe_32k.model")
    model, texts = sentencepiece.SentencePieceProcessor(model_file=path), texts_of(docs)
    cache = str(tmp_path / "cache")
    for _ in range(2):
        rows = token_counts.token_counts(docs, path, cache).collect()
        assert len(rows) == docs.count()
        assert all(r.n_tokens == len(model.encode(texts[r.doc_id] or "")) and r.n_bytes == len((texts[r.doc_id] or "").encode()) for r in rows)
    assert docs.sparkSession.read.parquet(cache).count() == len({t or "" for t in texts.values()})
    assert token_counts.token_counts(nothing, path).count() == 0


def test_token_counts_encode_misses_alone(spark, tmp_path, monkeypatch):
    path, cache = P.path("piece_bpe_32k.model"), str(tmp_path / "cache")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    schema, mark = "doc_id long, text string", token_counts.MARK
    token_counts.token_counts(spark.createDataFrame([(1, "one two"), (2, "long " * 50_000)], schema), path, cache).count()
    stored = spark.read.parquet(cache)
    stored.where("n_tokens < 100").selectExpr("digest", "version", "n_tokens + 1000 n_tokens").write.parquet(str(tmp_path / "changed"))
    later = spark.createDataFrame([(1, "one two"), (3, f"one{mark}two"), (4, "three"), (4, "three"), (None, "one two")], schema)
    rows = token_counts.token_counts(later, path, str(tmp_path / "changed")).collect()  # a hit keeps the count that was stored
    known = len(model.encode("one two"))
    assert known == len(model.encode(f"one{mark}two"))
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == sorted([(1, known + 1000), (3, known + 1000), (0, known + 1000)] + [(4, len(model.encode("three")))] * 2)
    assert spark.read.parquet(str(tmp_path / "changed")).count() == 2


def counts_by_hand(text):
    words, lines = re.findall(WORD, text), [x for x in text.split("\n") if re.search(WORD, x)]
    seen, covered = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7)), set()
    for i in range(len(words) - 7):
        if seen[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, nothing, spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    texts = texts_of(docs)
    for r in quality_rules.quality_rules(docs, labels).collect():
        want = counts_by_hand(texts[r.doc_id] or "")
        assert tuple(r[1:6]) == want and r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and r.kept == (not r.base_failed)
    assert quality_rules.quality_rules(nothing, labels).count() == 0


def test_quality_rules_learn_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = labels.where("doc_id % 2 = 0")
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs, known).collect()}
    held = labels.where("doc_id % 2 = 1").collect()
    good = [got[r.doc_id] for r in held if r.quality == 1 and not r.toxic]
    bad = [got[r.doc_id] for r in held if r.quality == 0]
    assert np.mean(good) > 0.9 and np.mean(bad) < 0.2


@pytest.mark.parametrize("bad", [1, 5, 20, 70])
@pytest.mark.parametrize("gap", [0.2, 1, 5, 50])
def test_scaling_keeps_good_rows_beside_few_bad_ones(bad, gap):
    rng = np.random.default_rng(bad)
    z, good = np.concatenate([rng.normal(0, 1, bad), rng.normal(gap, 1, 1000)]), np.repeat([0, 1], [bad, 1000])
    for scale in (0.01, 1, 100):
        slope, offset = quality_rules.platt(z * scale + 7, good)
        p = 1 / (1 + np.exp(-(slope * (z * scale + 7) + offset)))
        assert (p[good == 1] >= quality_rules.THRESHOLD).mean() >= 0.9
        assert gap < 5 or bad < 5 or (p[good == 0] < quality_rules.THRESHOLD).mean() >= 0.8


def test_quality_rules_catch_toxic_rows(spark):
    rng, words = np.random.default_rng(7), [f"w{i}" for i in range(300)]
    bad = ["idiot", "moron", "scum"]
    rows, labels = [], []
    for i in range(240):
        text = [str(w) for w in rng.choice(words, 40 + i % 200)]
        if i % 4 == 0:
            text[i % 7] = bad[i % 3]
        rows.append((i, " ".join(text)))
        if i < 160:
            labels.append((i, 1, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert np.mean([kept[i] for i in range(160, 240) if i % 4]) > 0.95 and np.mean([kept[i] for i in range(160, 240, 4)]) < 0.1


def test_media_round_trip(docs, nothing):
    texts = texts_of(docs)
    for r in media.audio_digests(docs).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-64:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(media.to_wav(payload)).hexdigest()
    assert media.audio_digests(nothing).count() == 0
    import pyarrow as pa

    row = media.audio_features(docs.where("doc_id = 0")).first()
    back = pa.ipc.open_stream(row.tensors).read_all()
    assert back.schema.field("mel").type.shape == [media.PATCH, media.MELS]


def test_media_digests_are_of_the_stored_rows(docs, monkeypatch):
    some, stored = docs.where("doc_id in (0, 8, 12)"), media.audio_features
    monkeypatch.setattr(media, "audio_features", lambda d: stored(d.selectExpr("doc_id", "concat(text, '!') text")))
    changed = {r.doc_id: r for r in media.audio_digests(some).collect()}
    monkeypatch.undo()
    plain = {r.doc_id: r for r in media.audio_digests(some).collect()}
    assert changed[0].n_bytes == plain[0].n_bytes + 1 and changed[0].media_sha256 != plain[0].media_sha256 and changed[8] == plain[8]
    for r in plain.values():
        blocks, _, frames = media.analyse(media.payload_of(texts_of(docs)[r.doc_id] or "")[0])
        assert f"frames={frames};" in r.feature and r.feature.endswith(f"mel={zlib.crc32(np.rint(blocks * 16).astype(np.int16).tobytes()):08x}")


def features_by_hand(samples):
    """Log-mel frames and segments of 8-bit samples, by sums over one output at a time."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float64) - 128) / 128
    taps, up, down, rate = media.TAPS, media.UP, media.DOWN, media.RATE
    weights = np.empty((taps, up))
    for p in range(up):
        for t in range(taps):
            d = t - taps // 2 + 1 - p * down / up
            weights[t, p] = up / down * np.sinc(up / down * d) * np.cos(np.pi * d / (taps + 2)) ** 2
    weights /= weights.sum(0)
    n = -(-len(x) // down)
    y = np.array([sum(weights[t, p] * x[i] for t in range(taps) if 0 <= (i := down * k + t - taps // 2 + 1) < len(x)) for k in range(n) for p in range(up)])
    mel = lambda hz: 2595 * np.log10(1 + hz / 700)
    edges = 700 * (10 ** (np.linspace(mel(60), mel(rate / 2), media.MELS + 2) / 2595) - 1)
    window = [0.5 - 0.5 * np.cos(2 * np.pi * i / media.FRAME) for i in range(media.FRAME)]
    turn = np.exp(-2j * np.pi * np.outer(np.arange(media.FRAME), np.arange(media.FFT // 2 + 1)) / media.FFT)
    frames = []
    for k in range(max(1, 1 + -(-(len(y) - media.FRAME) // media.HOP))):
        part = np.zeros(media.FRAME)
        own = y[k * media.HOP : k * media.HOP + media.FRAME]
        part[: len(own)] = own
        power = np.abs((part * window) @ turn) ** 2
        hz = np.arange(len(power)) * rate / media.FFT
        bands = [sum(p * max(0, min((h - lo) / (mid - lo), (hi - h) / (hi - mid))) for p, h in zip(power, hz)) for lo, mid, hi in zip(edges, edges[1:], edges[2:])]
        frames.append(np.log10(np.array(bands) + 1e-6))
    energy = np.array(frames).mean(1)
    level, spread, found, begin, top = energy.mean(), energy.std(), [], None, False
    for k, e in enumerate([*energy, -np.inf]):
        if e > level + media.FALL * spread and spread >= 1e-9:
            begin, top = (k if begin is None else begin), top or e > level + media.RAISE * spread
        elif begin is not None:
            if top:
                found.append((begin * media.HOP / rate, ((k - 1) * media.HOP + media.FRAME) / rate))
            begin, top = None, False
    return np.array(frames), found


def test_media_features_match_plain_sums(spark):
    texts = ["a" * 200, "Some text, with words. " * 40, "é漢😀" * 300 + " tail " * 100, None, "x" * 64 + "zzz   " * 300]
    rows = media.audio_features(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        frames, segments = features_by_hand(media.from_wav(bytes(r.media)))
        stored = pa.ipc.open_stream(bytes(r.tensors)).read_all()
        blocks = stored.column("mel").combine_chunks().to_numpy_ndarray().reshape(-1, media.MELS)
        assert r.frames == len(frames) and np.allclose(blocks[: len(frames)], frames, atol=2e-3) and not blocks[len(frames) :].any()
        assert stored.column("begin_s").to_pylist() == pytest.approx([k * media.PATCH * media.HOP / media.RATE for k in range(len(stored))])
        assert [x for s in r.segments for x in (s.begin_s, s.end_s)] == pytest.approx([x for s in segments for x in s])


def test_media_blocks_join_without_a_seam(monkeypatch):
    samples = np.random.default_rng(3).integers(0, 256, 20_000, np.uint8).tobytes()
    whole = media.analyse(samples)
    monkeypatch.setattr(media, "BLOCK", 64)
    parts = media.analyse(samples)
    assert np.allclose(whole[0], parts[0], atol=1e-4) and whole[2] == parts[2]


def tiktoken_encoding():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_matches_the_library(docs, nothing):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    library, texts = tiktoken_encoding(), texts_of(docs)
    for r in byte_bpe.byte_bpe(docs, path, P.PATTERN).collect():
        text = texts[r.doc_id] or ""
        assert r.ids == library.encode_ordinary(text) and bytes(r.decoded) == text.encode()
    for r in byte_bpe.byte_bpe_digests(docs, path, P.PATTERN).collect():
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert byte_bpe.byte_bpe(nothing, path, P.PATTERN).count() == 0


@pytest.mark.parametrize("size", [128, 129, 16_384, 16_385, 65_537, 200_000])
def test_long_pieces_match_the_library(size):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    library, own = tiktoken_encoding(), byte_bpe.ByteBpe(path, P.PATTERN)
    known = [t.decode() for t in own.ranks if t.isalpha() and t.isascii()]
    letters = "".join(known[k * 7919 % len(known)] for k in range(size // 2))[:size]
    for text in (letters, "".join(chr(0x4E00 + k * 7919 % 5000) for k in range(size // 3 + 1)), ("!?#=-*" * size)[:size], " " * size):
        ids = own.encode(text)
        assert ids == library.encode(text, disallowed_special=()) and own.decode(ids).decode() == text


def test_main_text(spark):
    page = "<html><head><title>T</title><script>var a='</p>';</script></head><body><header>Menu</header><nav><a href=/>Home</a></nav><div class='ad'>Buy</div><article><h1>Head &amp; tail</h1><p>First  one<br>line.<p>Short.<div class=comments><p>Nice!</p></div><aside>See</aside><form>Go</form></article><footer>&copy;</footer></body></html>"
    rows = html_extract.extract_text(spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", "")], "page_id long, url string, html string")).collect()
    assert [(r.text, r.n_chars) for r in rows] == [("Head & tail First one line. Short.", 34), ("", 0), ("", 0)]


def article_by_hand(page):
    """Blocks of the one article that each test page has: no boilerplate is inside."""
    body = re.search("(?s)<article>(.*?)</article>", page)[1]
    blocks = [re.sub("<[^>]*>", "", re.sub("<br>", " ", b)) for b in re.split("</?(?:p|h1|h2|ul|li)>", re.sub("(?s)<!--.*?-->", "", body))]
    return " ".join(t for b in blocks if (t := " ".join(html.unescape(b).split())))


def test_main_text_of_whole_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = pages.join(html_extract.extract_text(pages).select("page_id", "text", "n_chars"), "page_id").collect()
    assert len(rows) == pages.count()
    for r in rows:
        assert r.text == article_by_hand(r.html) and r.n_chars == len(r.text)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><h1>Search engines</h1><div id="search-results"><p>hi there</p></div></article>', "Search engines hi there"),
        ("<article><ul><li><a href=x>One</a></li><li>two</li></ul></article>", "One two"),
        ("<body><p>short text</p></body>", "short text"),
        ("plain &amp;  words", "plain & words"),
        ('<body><nav><a href=x>Home</a></nav><p>short text</p><div class="main-menu">go</div><footer>2020</footer></body>', "short text"),
        ('<article><p data-id="share">kept</p><div class="share-buttons">no</div><div class="article-header">title</div></article>', "kept title"),
        ("<article>" + f"<p>{'word of the ' * 20}</p>" + "<p>" + "<a href=x>somewhere else entirely</a> " * 9 + "</p><p>near the links</p>" + f"<p>{'and so it is ' * 20}</p></article>", " ".join(["word of the"] * 20 + ["near the links"] + ["and so it is"] * 20)),
        ("<p>" + "zzz qqq " * 60 + "</p><p>" + "this is what they said of it " * 9 + "</p>", " ".join(["this is what they said of it"] * 9)),
    ],
)
def test_main_text_of_odd_pages(page, text):
    assert html_extract.main_text(page) == text


def test_main_text_of_repeated_long_and_clashing_rows(spark):
    long = "<article>" + "<p>the words of it are many and they go on</p>" * 20_000 + "</article>"
    rows = [(1, "u", long, "a"), (1, "u", long, "b"), (2, None, None, "c"), (3, "u", "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract_text(pages).sort("page_id").collect()
    assert [(r.page_id, r.n_chars) for r in got] == [(1, 20_000 * 40 - 1)] * 2 + [(2, 0), (3, 0)] and html_extract.extract_text(pages.limit(0)).count() == 0


def test_language_model(docs, nothing, spark):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20, 79)] + [(20, 1, 0), (3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in ngram_lm.lm_quality(docs, labels).collect()}
    assert len(rows) == docs.distinct().count() and rows[8].score is None and not rows[8].kept and not rows[9].kept
    assert rows[0].score == rows[1].score and rows[60].kept
    assert ngram_lm.lm_quality(nothing, labels).count() == 0
    untrained = {r.doc_id: r.kept for r in ngram_lm.lm_quality(docs, labels.limit(0)).collect()}
    assert all(kept == bool(text) for text, kept in zip(odd_texts(), (untrained[i] for i in range(len(odd_texts()))), strict=True))


def test_language_model_carries_rows(docs, spark):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20, 79)], "doc_id long, quality int, toxic int")
    rows = docs.unionByName(docs.limit(2).selectExpr("cast(null as long) as doc_id", *[f"`{c}`" for c in docs.columns[1:]]))
    carried = ngram_lm.lm_quality(rows, labels, carry=True).select("row.*")
    assert carried.columns == docs.columns
    assert Counter(carried.collect()) == Counter(rows.collect())


def plain_model(texts, order=ngram_lm.ORDER):
    """Probability of a unit after others, by Chen and Goodman's formulas over plain counters."""
    counts = {order: Counter()}
    for text in texts:
        units = [0] * (order - 1) + units_of(text)
        counts[order].update(tuple(units[i : i + order]) for i in range(len(units) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    known = {}
    for k, own in counts.items():
        n1, n2, n3, n4 = (sum(1 for n in own.values() if n == i) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 and n3 else None
        d = (0.5, 1.0, 1.5) if y is None else [min(max(x, 0.05), i - 0.05) for i, x in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), 1)]
        total, left = Counter(), Counter()
        for g, n in own.items():
            total[g[:-1]] += n
            left[g[:-1]] += d[min(n, 3) - 1]
        known[k] = own, d, total, left

    def p(gram):
        if not gram:
            return 1 / ngram_lm.UNITS
        own, d, total, left = known[len(gram)]
        n, c = own.get(gram, 0), gram[:-1]
        if c not in total:
            return p(gram[1:])
        return ((n - d[min(n, 3) - 1]) if n else 0) / total[c] + left[c] / total[c] * p(gram[1:])

    return p


def units_of(text):
    return np.frombuffer(text.replace("\0", "\1").encode("utf-16-le"), np.uint16).tolist()


def test_language_model_matches_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "BUNDLE", 700)
    texts = [t for t in odd_texts() if t] + ["née \0 漢字 \U0001f600", "zzz qqq"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(8, len(texts), 2)], "doc_id long, quality int, toxic int")
    out = {r.doc_id for r in labels.where(ngram_lm.left_out()).collect()}
    p = plain_model([texts[i] for i in range(8, len(texts), 2) if i not in out])
    got = {r.doc_id: r for r in ngram_lm.lm_quality(rows, labels).collect()}
    for i, text in enumerate(texts):
        units = [0] * (ngram_lm.ORDER - 1) + units_of(text)
        grams = [tuple(units[k : k + ngram_lm.ORDER]) for k in range(len(units) - ngram_lm.ORDER + 1)]
        assert got[i].score == pytest.approx(-sum(np.log(p(g)) for g in grams) / len(grams), rel=1e-5)
    held = sorted(got[i].score for i in out)
    limit = held[int(np.ceil(ngram_lm.QUANTILE * len(held))) - 1] + ngram_lm.MARGIN
    assert all(r.threshold == pytest.approx(limit) and r.kept == (r.score <= limit) for r in got.values())
    assert sum(p((*units_of("the"), u)) for u in range(ngram_lm.UNITS)) == pytest.approx(1)


def test_url_rules(spark):
    urls = ["http://A.Example.com/en/7x?q", "https://b.com/en/8", "http://m.example.net/de/8/1", "http://x.net/de/1#t", "http://badcom/en/1", "nothing", None, "http://h.org", "http://com/en/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages).collect()}
    assert got[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow") and got[1] == ("b.com", "/en/8", "com/en/", "block")
    assert got[2][2:] == ("example.net/de/8", "block") and got[3][2:] == ("net/de/", "allow") and got[4][2] is None
    assert got[5][:3] == ("", "", None) and got[6][:3] == ("", "", None) and got[7][:3] == ("h.org", "", None) and got[8][2:] == ("com/en/", "block")
    assert url_filter.url_filter(pages.where("page_id < 0")).count() == 0


def template_verdicts_by_hand(leaves):
    """Verdicts of {segments: (blocked, labelled, pages)} on one host, by a recursive walk down the tree."""

    def alike(b, n, of):
        all_b, all_n = sum(x[0] for x in of), sum(x[1] for x in of)
        return (b * all_n - all_b * n) ** 2 <= 4 * all_b * (all_n - all_b) * n

    def shaped(own, of):
        n, total = sum(own.values()), sum(sum(o.values()) for o in of)
        bound = np.sqrt(0.5 * np.log(2 / url_filter.LEVEL)) * (1 / np.sqrt(n) + 1 / np.sqrt(total))
        return all(abs(own[c] / n - sum(o[c] for o in of) / total) <= bound for o in of for c in o)

    groups = []

    def walk(members, place):
        ends, children = [m for m in members if len(m) == place], defaultdict(list)
        groups.append(ends)
        deeper = [m for m in members if len(m) > place]
        many = len({m[place] for m in deeper}) > url_filter.FAN_OUT
        for m in deeper:
            children["*" if many else m[place]].append(m)
        counts = {s: [sum(leaves[m][k] for m in ms) for k in (0, 1)] for s, ms in children.items()}
        kids = {s: Counter() for s in children}
        for s, ms in children.items():
            for m in ms:
                kids[s][m[place + 1] if len(m) > place + 1 else None] += leaves[m][2]
        same = [s for s in children if len(children) >= 2 and alike(*counts[s], counts.values()) and shaped(kids[s], kids.values())]
        if same:
            walk([m for s in same for m in children[s]], place + 1)
        for s in children:
            if s not in same:
                walk(children[s], place + 1)

    walk(list(leaves), 0)
    out = {}
    for g in groups:
        of = [leaves[m] for m in g]
        near = [m for m in g if alike(*leaves[m][:2], of)]
        for m in g:
            b, n = (sum(leaves[x][k] for x in near) for k in (0, 1)) if m in near else leaves[m][:2]
            out[m] = "block" if (b + 1) / (n + 4) >= 0.8 else "allow"
    return out


def test_templates_merge_at_every_depth(spark):
    rng, urls = np.random.default_rng(11), []
    # below /a: x and y are blocked by rules, z has no labels and is built alike; b is good, w is built otherwise
    given = {("a", "x", "k"): (90, 90), ("a", "y", "k"): (80, 80), ("a", "z", "k"): (0, 0, 30), ("b", "x", "k"): (0, 300), ("b", "q", "k"): (0, 0, 40), ("w", "v", "u", "t"): (0, 0, 200)}
    hosts = {"one.org": given}
    hosts["two.org"] = {("c", "m"): (12, 12), ("d", "m"): (15, 15), ("e", "m"): (0, 0), ("e", "n"): (0, 0), ("c", "n"): (6, 6), ("d", "n", "r"): (0, 0)}
    hosts["three.org"] = {("p", f"s{chr(97 + k % 26)}{chr(97 + k // 26)}"): (2, 2) if k % 2 else (0, 0, 2) for k in range(60)}
    for k in range(4):
        hosts[f"h.{'abcd'[k]}.net"] = {tuple(str(rng.choice(list("stuv"))) for _ in range(int(rng.integers(1, 5)))): (lambda n: (int(rng.choice([0, n // 2, n])), n))(int(rng.choice([0, 0, 5, 20]))) for _ in range(25)}
    for host, leaves in hosts.items():
        for segments, (bad, n, *own) in list(leaves.items()):
            path, more = "/".join(segments), own[0] if own else 1
            urls += [f"http://{host}/{path}?bad"] * bad + [f"http://{host}/{path}?good"] * (n - bad) + [f"http://{host}/{path}?own"] * more
            leaves[segments] = bad, n, n + more
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    ruled = url_filter.parsed(pages).join(pages, "page_id").selectExpr("page_id", "host", "path", "case when url like '%?bad' then 'block' when url like '%?good' then 'allow' end ruled")
    found = {(r.host, r.form): r.by_template for r in url_filter.templates(ruled.selectExpr("*", "substr(path, 2) form")).collect()}
    want = {(h, "/".join(s)): v for h, leaves in hosts.items() for s, v in template_verdicts_by_hand(leaves).items()}
    assert found == want
    assert found["one.org", "a/z/k"] == "block" and found["two.org", "e/m"] == "block" and found["one.org", "b/q/k"] == found["one.org", "w/v/u/t"] == "allow" and found["three.org", "p/sba"] == "block"


def test_unlabelled_urls_take_the_verdict_of_folders_built_alike(spark):
    paths = [f"/s/{x}/p" for x in "kl" for _ in range(10)] + ["/s/m/p", *["/t/m"] * 30, "/s/k/" + "p" * 5000, None]
    pages = spark.createDataFrame([(i, p and "http://a.org" + p) for i, p in enumerate(paths)], "page_id long, url string")
    got = [r.verdict for r in url_filter.url_filter(pages.unionByName(pages), (("block", "org/s/k/"), ("block", "org/s/l/"))).sort("page_id").collect()]
    assert got == ["block"] * 42 + ["allow"] * 60 + ["block"] * 2 + ["allow"] * 2


def components_by_hand(texts, size):
    sets = {}
    for i, t in texts.items():
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(WORD, t or "")]
        sets[i] = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, size):
    want = components_by_hand(texts_of(docs), size)
    rows = near_dedup.near_dedup(docs, size).collect()
    assert len(rows) == docs.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want and all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_duplicates_of_nothing(nothing):
    assert near_dedup.near_dedup(nothing).count() == 0


def test_large_families_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "MEMBERS", 3)
    rng, words = np.random.default_rng(5), [f"w{i}" for i in range(400)]
    texts = []
    for size in (20, 24, 30, 60):  # chains of edits: links of near texts, none of far ones
        now = list(rng.choice(words, size))
        for _ in range(25):
            now = list(now) + [str(rng.choice(words))] * int(rng.integers(0, 2))
            now[int(rng.integers(len(now)))] = str(rng.choice(words))
            texts.append(" ".join(now))
    texts += [texts[3], texts[40]]
    sets = [{tuple(t.split()[i : i + 2]) for i in range(len(t.split()) - 1)} for t in texts]
    owner = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((owner[i], owner[j]))
                owner = [a if x == b else x for x in owner]
    rows = near_dedup.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 2).collect()
    assert {r.doc_id: r.component_id for r in rows} == dict(enumerate(owner)) and len(set(owner)) > 5


def test_intersections_are_exact():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 30_000, n, np.uint64)) for n in (1, 5, 20_000, 25_000, 25_000)]
    assert near_dedup.intersections(sets).tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in sets] for x in sets]


def test_comparing_and_joining_links_share_no_stage(docs, monkeypatch):
    found, chained = near_dedup.forests, []
    monkeypatch.setattr(near_dedup, "forests", lambda edges: chained.append("MapInArrow" in edges._jdf.queryExecution().toString()) or found(edges))
    near_dedup.near_dedup(docs, 2).count()
    assert len(chained) == 3 and not any(chained)  # each task of such a stage would need two Python workers


def test_batches_are_bounded_by_bytes(spark):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "size": [batch.nbytes]})

    wide = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    sent = common.map_arrow(wide, run, "rows long, size long").collect()
    assert sum(r.rows for r in sent) == 40 and max(r.size for r in sent) < common.BATCH_BYTES + (2 << 20)


def test_tasks_give_their_memory_back(spark):
    def resident():
        return int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read())[1]) >> 10

    def run(batches):
        for _ in batches:
            before = resident()
            held = [bytearray(100_000) for _ in range(2_000)]
            common.last_block = held[-1]  # above it nothing is free, so that the allocator alone gives nothing back
            peak = resident()
            del held
            yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "before": [before], "peak": [peak]})

    df = common.map_arrow(spark.range(0, 1, 1, 1), run, "pid long, before long, peak long")
    rows = [df.collect()[0] for _ in range(12)]
    again = [(a, b) for i, b in enumerate(rows) for a in rows[:i] if a.pid == b.pid]
    assert again and all(b.before < a.peak - 100 for a, b in again)
