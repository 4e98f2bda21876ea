"""Operators 1, 2, 4, 9 and 10 against brute force on the small corpus."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

from talentmill.llm import decontaminate, media, packing, sharding, tokens
from talentmill.llm.queries import tokenizer_path
from tests.llm.fixture import corpus, empty, prose, rows

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")


def test_token_counts(spark):
    t = Tokenizer.from_file(BYTE)
    want = Counter((d, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 512) for d, x, *_ in rows())
    got = tokens.count_tokens(corpus(spark), BYTE, table_size=20, summary_size=10)
    assert Counter(map(tuple, got.collect())) == want
    assert tokens.count_tokens(empty(spark), BYTE).count() == 0


@pytest.mark.parametrize("text", ["", " ", "  ", "a  b", " a", "a ", "a\n b", "a \nb", "a\n\nb c", "x\x1cy z", "tab\tb  c ", "don't  'll"])
def test_units_add_up(text):
    t = Tokenizer.from_file(BYTE)
    assert tokens.encoder(BYTE).count(text, {}) == len(t.encode(text, add_special_tokens=False).ids)
    assert "".join(tokens.units(text)) == text


def test_packing(spark):
    t = Tokenizer.from_file(WORD)
    whole = {}
    for d, x, *_ in rows():
        whole[(d, x or "")] = [*t.encode(x or "", add_special_tokens=False).ids, 2]
    got = packing.pack(corpus(spark), WORD, shard_tokens=20_000, block_docs=16).collect()
    by_window, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
        by_window[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for pieces in by_window.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0
    ids = Counter(int.from_bytes(r.ids[i : i + 4], "little") for r in got for i in range(0, len(r.ids), 4))
    copies = Counter((d, x or "") for d, x, *_ in rows())
    want = Counter()
    for k, n in copies.items():
        want.update({i: c * n for i, c in Counter(whole[k]).items()})
    assert ids == want
    for d in range(40):
        data = b"".join(r.ids for r in sorted(by_doc[d], key=lambda r: r.start))
        assert data == b"".join(i.to_bytes(4, "little") for i in whole[(d, prose(d))])
        assert {r.doc_tokens for r in by_doc[d]} == {len(whole[(d, prose(d))])}
    assert packing.pack(empty(spark), WORD).count() == 0


def test_packing_takes_the_tokenizers_ids():
    import numpy as np

    t, own = Tokenizer.from_file(WORD), packing.PieceIds(WORD, room=50)
    plain = [chr(c) for c in range(0x2100) if packing._PLAIN(chr(c))]
    texts = ["5 \xb5m, a\xb5B", "caf\xe9\x7f \xc9t\xe9's", "x\xa0y\x0bz\x0c 'street ''ll \"'s 123", "it\u2019s \u01c4 <|endoftext|> a\x1cb", "", " ", "a" * 3000]
    texts += [x for c in plain for x in (c, f"Aa{c}bB", f"{c}'s{c}1")]
    for some in (texts[:8], texts, texts[::-1]):
        for x, ids in zip(some, own.encode(some, 2), strict=True):
            assert np.frombuffer(ids, own.kind).tolist() == [*t.encode(x, add_special_tokens=False).ids, 2], x


def test_packing_looks_each_distinct_word_up_once():
    class Counted(packing.PieceIds):
        asked = 0

        def __getitem__(self, piece):
            self.asked += 1
            return super().__getitem__(piece)

    own = Counted(WORD)
    assert len(set(own.encode(["The word, the other word."] * 500, 2))) == 1 and own.asked < 20


def test_packing_orders_neighbours_on_demand():
    import numpy as np

    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 300, rng.integers(1, 40)) for _ in range(200)] + [np.arange(9)] * 5
    index = packing.Index(np.concatenate(docs), np.append(0, np.cumsum([len(d) for d in docs])), rng.random(300).astype(np.float32), 20.0)
    unused = rng.random(205) < 0.8
    for most in (3, 64, 150, 1000):
        assert [*index.nearest(7, unused, most, first=10)] == index.neighbours(7, unused, most).tolist()


def test_packing_puts_like_with_like(spark):
    from tests.llm.fixture import SCHEMA

    topics = [(i, " ".join(f"topic{i % 4}word{(i * 7 + j) % 30}" for j in range(60)), "en", "s", 0, "") for i in range(80)]
    got = packing.pack(spark.createDataFrame(topics, SCHEMA), WORD).collect()
    near = defaultdict(set)
    for r in got:
        near[r.sequence_id].add(r.doc_id % 4)
    assert sum(len(s) for s in near.values()) / len(near) < 3


def test_packing_finds_neighbours_in_the_whole_shard(spark):
    from tests.llm.fixture import SCHEMA

    words = [f"q{a}{b}" for a in "bcdfghjk" for b in "aeiou"]
    # 75 documents a topic among 3000: more than a block of 1024 would hold together
    docs = [(i, " ".join([f"rare{i % 40}x{j}" for j in range(40)] + [words[i % 40], f"own{i}"] + [f"u{(i * 31 + j) % 5000}" for j in range(60)]), "en", "s", 0, "") for i in range(3000)]
    got = packing.pack(spark.createDataFrame(docs, SCHEMA), WORD).collect()
    near = defaultdict(list)
    for r in got:
        near[r.sequence_id].append(r.doc_id % 40)
    alike = sum(Counter(x).most_common(1)[0][1] for x in near.values()) / sum(map(len, near.values()))
    assert alike >= 0.9, alike


def test_packing_scores_every_term():
    import numpy as np

    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 400, rng.integers(1, 300)) for _ in range(300)]
    idf = rng.random(500).astype(np.float32) + 0.1
    index = packing.Index(np.concatenate(docs), np.append(0, np.cumsum([len(d) for d in docs])), idf, 100.0)
    unused = rng.random(300) < 0.7
    for shrunk in (False, True):
        if shrunk:
            unused &= rng.random(300) < 0.4
            index.drop_used(unused)
        for seed in (0, 5, 77):
            terms, want = set(docs[seed].tolist()), {}
            for i in np.flatnonzero(unused):
                tf = Counter(docs[i].tolist())
                want[int(i)] = sum(idf[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(docs[i]) / 100)) for t in terms if t in tf)
            best = index.neighbours(seed, unused, 20).tolist()
            scores = sorted((x for x in want.values() if x > 0), reverse=True)[:20]
            assert len(best) == len(set(best)) == len(scores) and all(abs(want[d] - x) < 1e-3 * x for d, x in zip(best, scores, strict=True))


def test_shards(spark):
    got = sharding.assign_shards(corpus(spark), n_shards=6, n_slots=256).collect()
    want = Counter((d, len((x or "").encode()) + 8, zlib.crc32((x or "").encode())) for d, x, *_ in rows())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r)
        assert r.law == "bytes" and r.grown_shard is None
    for members in by_shard.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    assert sharding.assign_shards(empty(spark)).count() == 0


def test_shards_balance_and_keep_their_map(spark, tmp_path):
    from tests.llm.fixture import SCHEMA

    rows = [(i, prose(i, 30 + i % 50), "en", "s", 0, "") for i in range(2000)] + [(7, "the same", "en", "hot", 0, "")] * 3000
    frame, path = spark.createDataFrame(rows, SCHEMA), str(tmp_path / "map")
    for version, n_shards in ((1, 8), (2, 9), (3, 9)):
        got = sharding.assign_shards(frame, n_shards, 512, map_path=path, least=20).collect()
        loads, places = Counter(), defaultdict(list)
        for r in got:
            loads[r.shard] += r.size
            places[r.shard].append(r.slot)
        assert len(got) == len(rows) and {r.map_version for r in got} == {version} and len(loads) == n_shards
        assert max(loads.values()) <= 1.05 * sum(loads.values()) / n_shards
        assert all(sorted(x) == [*range(len(x))] for x in places.values())
        one_slot = Counter(r.vslot for r in got if r.doc_id == 7 and r.size == 16)
        assert max(one_slot.values()) < 60  # repeats are dealt over the slots
    assert sharding.SlotMap.stored(spark, path).version == 3 and sharding.SlotMap.stored(spark, str(tmp_path / "none")) is None


def test_slot_map_edits(spark):
    weights = [10 + i % 7 for i in range(4096)]
    one = sharding.first_map(weights, 24)
    assert max(one.loads(weights)) <= 1.01 * min(one.loads(weights))
    two = sharding.rebalance(one, weights, 25)
    moved = [i for i, (a, b) in enumerate(zip(one.shards, two.shards, strict=True)) if a != b]
    assert two.version == 2 and all(two.shards[i] == 24 for i in moved) and max(two.loads(weights)) <= 1.03 * sum(weights) / 25
    assert sharding.SlotMap.read(one.table(spark).union(two.table(spark))) == two


def test_media(spark):
    got = {r.doc_id: r for r in media.media_digest(corpus(spark)).collect() if r.doc_id is not None}
    whole = {r.doc_id: r for r in media.media_columns(corpus(spark)).collect() if r.doc_id is not None}
    for d, x, *_ in rows():
        if d is None:
            continue
        n, payload = media.padded(x or "")
        r, w = got[d], whole[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert bytes(w.payload) == payload and r.media_sha256 == hashlib.sha256(w.media).hexdigest() and r.media_bytes == len(w.media)
        assert (r.codec, r.seconds) == (w.codec, w.seconds) and r.keyframes == ",".join(f"{k.begin}:{k.length}" for k in w.keyframes)
        assert b"".join(bytes(w.media)[k.begin : k.begin + k.length] for k in w.keyframes) == payload
    assert media.media_digest(empty(spark)).count() == 0
    assert media.features(b"")["codec"] is None and media.features(bytes(w.media)[:300])["codec"] is None


def test_media_damage():
    import random

    whole = media.mux(bytes(range(256)) * 36, key_every=5)
    head = whole.index(b"mdat")
    sound = media.features(whole)
    assert sound["codec"] == "raw " and len(sound["samples"]) == 48
    r = random.Random(4)
    for _ in range(3000):
        bad = bytearray(whole[: r.choice((len(whole), r.randrange(len(whole))))])
        for _ in range(r.randrange(1, 4)):
            if bad:
                bad[r.randrange(min(head, len(bad)))] = r.choice((0, 1, 255, r.randrange(256)))
        got = media.features(bytes(bad))
        assert got == media.NOTHING or all(0 <= at and at + n <= len(bad) for at, n in got["samples"])
    at = whole.index(b"stsc") + 8  # a count of runs beyond the box
    assert media.features(whole[:at] + b"\xff\xff\xff\xff" + whole[at + 4 :]) == media.NOTHING
    trak = whole.index(b"trak") - 4
    size = int.from_bytes(whole[trak : trak + 4])
    empty_track, moov = media.box(b"trak"), whole.index(b"moov") - 4
    two = whole[:moov] + (int.from_bytes(whole[moov : moov + 4]) + 8).to_bytes(4) + whole[moov + 4 : trak] + empty_track + whole[trak:]
    assert media.features(two)["codec"] == "raw " and size > 0  # the first sound track


def test_other_tokenizers_get_whole_texts():
    t = Tokenizer.from_file(BYTE)
    texts = ["Hello world, it's here", "", " a  b ", "don't", *(x or "" for _, x, *_ in rows()[:3])]
    assert packing.PieceIds(BYTE).in_pieces is False and packing.PieceIds(WORD).in_pieces is True
    own = packing.PieceIds(BYTE)
    import numpy as np

    for text, ids in zip(texts, own.encode(texts, 2), strict=True):
        assert np.frombuffer(ids, own.kind).tolist() == [*t.encode(text, add_special_tokens=False).ids, 2]
    word = Tokenizer.from_file(WORD)
    assert [tokens.UnitEncoder(WORD).count(x, {}) for x in texts] == [len(word.encode(x, add_special_tokens=False).ids) for x in texts]


def test_texts_of_several_megabytes(spark):
    from talentmill.llm import jaccard, pii, suffixes
    from tests.llm.fixture import SCHEMA

    long = " ".join(prose(i, 1000) for i in range(500))
    frame = spark.createDataFrame([(1, long, "en", "s", 0, ""), (2, long + " tail", "en", "s", 0, ""), (3, "ab" * 1_500_000, "en", "s", 0, "")], SCHEMA)
    t = Tokenizer.from_file(BYTE)
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(frame.where("doc_id < 3"), BYTE).collect()} == {d: len(t.encode(x, add_special_tokens=False).ids) for d, x in ((1, long), (2, long + " tail"))}
    assert {(r.doc_id, r.component_id) for r in jaccard.near_duplicates(frame, 5, 4, 5).collect()} == {(1, 1), (2, 1), (3, 3)}
    assert {r.doc_id: r.n_bytes - r.n_removed for r in suffixes.remove_repeats(frame).collect()}[2] < 60
    assert {r.doc_id: r.payload_bytes for r in media.media_digest(frame).collect()}[3] == 3_000_000
    assert sum(r.length for r in packing.pack(frame.where("doc_id < 3"), WORD).collect()) > 1_000_000
    assert pii.report(frame).where("spans <> ''").count() <= 1
    assert decontaminate.contaminated(frame, spark.createDataFrame([(1, long[10_000:10_300])], "item_id long, text string")).count() == 2
    assert sharding.assign_shards(frame).count() == 3


def least_distance(item: str, text: str) -> int:
    last = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (a != b)))
        last = now
    return min(last)


def test_decontamination(spark):
    items = [(1, prose(900, 20)), (2, prose(901, 30)), (3, "Too short."), (4, None), (5, ""), (2, prose(901, 30))]
    edited = prose(901, 30).replace("e", "3", 2)
    far = " ".join(w if i % 2 else "zz" for i, w in enumerate(prose(900, 20).split()))
    docs = [(i, t, "en", "s", 0, "q") for i, t in enumerate([prose(1) + " " + prose(900, 20).upper() + "! " + prose(2), prose(3) + "\n" + edited, far, prose(900, 20), None, "", prose(5, 3000), prose(6) + " it was Too, short! " + prose(7), "not too shorts, tooshort"])]
    from tests.llm.fixture import SCHEMA

    frame, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (8_000_000, 100):
        got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated(frame, bench, block_bytes=block_bytes).collect()}
        want = {}
        for d, t, *_ in docs[:4]:
            for k, item in items[:2]:
                x = least_distance(decontaminate.normalise(item), decontaminate.normalise(t))
                if x <= len(decontaminate.normalise(item)) // 20:
                    want[(d, k)] = x
        assert {(0, 1), (1, 2), (3, 1)} == set(want) and got == {**want, (7, 3): 0}  # short items match as whole words only
    flagged = decontaminate.flag_contaminated(frame, bench)
    clash = decontaminate.flag_contaminated(frame.withColumnRenamed("score", "Contamination").withColumnRenamed("source", "text_"), bench)
    assert clash.columns[-1] == "contamination_" and {r.Contamination for r in clash.collect()} == {"q"} and clash.where("size(contamination_) > 0").count() == 4
    assert flagged.columns == [*frame.columns, "contamination"] and flagged.drop("contamination").exceptAll(frame).count() == 0
    assert decontaminate.contaminated(empty(spark), bench).count() == 0
    assert decontaminate.contaminated(frame, bench.limit(0)).count() == 0


def test_packing_leaves_no_tokenizer_in_the_driver(spark):
    from talentmill.llm import _common, packing
    from talentmill.llm.queries import tokenizer_path

    docs = spark.createDataFrame([(1, "some words"), (2, "some other words")], "doc_id long, text string")
    packing.pack(docs, tokenizer_path("word_bpe_49k.json"))
    assert not _common._WORKER
