import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pathkin.llm.materialise import _encoder, feistel, pack_sequences, read_shard, read_training_order, write_training_order

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_feistel_is_a_keyed_permutation(n):
    slots = feistel(np.arange(n), n, 5)
    assert sorted(slots.tolist()) == list(range(n))
    if n > 60:
        assert (slots != feistel(np.arange(n), n, 6)).any()


def test_sequences_hold_every_text_in_order(docs, rows):
    encode = _encoder(PATH, PATTERN).encode_ordinary
    assert isinstance(_encoder(PATH, PATTERN), tiktoken.Encoding)
    got = sorted(pack_sequences(docs, PATH, PATTERN, 50256, 64, group_docs=20).collect(), key=lambda r: (r.g, r.row))
    found, flow = {}, {}
    for r in got:
        ids, at = np.frombuffer(r.tokens, "<u2").tolist(), 0
        assert len(ids) == 64
        for d, n in zip(r.doc_ids, r.doc_tokens):
            found.setdefault(d, []).extend(ids[at : at + n])
            at += n
        assert set(ids[at:]) <= {50256}
        flow.setdefault(r.g, []).append(r.row)
    assert len(flow) > 2 and all(rows_ == list(range(len(rows_))) for rows_ in flow.values())
    for r in rows:
        want = [*encode(r[1] or ""), 50256]
        assert found[r[0]] == want * (2 if r[0] == 5 else 1)


def test_shards_depend_on_the_rows_alone(spark, docs, none, tmp_path):
    options = {"length": 64, "shard_rows": 100, "group_docs": 20}
    kept = {}
    for parts in (1, 7, 7):
        folder = tmp_path / f"{parts}-{len(kept)}"
        index = write_training_order(docs.repartition(parts), str(folder), "byte_bpe_50k.tiktoken", PATTERN, **options)
        kept[folder] = [(f.name, f.read_bytes()) for f in sorted(folder.iterdir())]
    assert len({repr(x) for x in kept.values()}) == 1 and all(name.startswith("shard-") for name, _ in kept[folder])
    got = sorted(index.collect())
    assert [r.slot for r in got] == list(range(len(got))) and len(got) > 300
    assert all((r.shard, r.row, r.offset, r.path) == (r.slot // 100, r.slot % 100, r.slot % 100 * 128, f"shard-{r.slot // 100:08d}.bin") for r in got)
    # slots are the permutation of the sequences in packing order
    packed = sorted(pack_sequences(docs, PATH, PATTERN, 50256, 64, 20).collect(), key=lambda r: (r.g, r.row))
    slots = feistel(np.arange(len(packed)), len(packed), 20)
    want = {int(s): r for s, r in zip(slots, packed)}
    whole = b"".join(data for _, data in kept[folder])
    assert all(whole[s * 128 : (s + 1) * 128] == bytes(r.tokens) for s, r in want.items()) and len(whole) == 128 * len(packed)
    read = {r.slot: r for r in read_training_order(index.filter("slot >= 137"), str(folder), length=64).collect()}  # resumed in a shard's middle
    assert read.keys() == set(range(137, len(packed))) and all(bytes(r.tokens) == bytes(want[s].tokens) and r.doc_ids == want[s].doc_ids for s, r in read.items())
    name = sorted(folder.iterdir())[1]
    assert [x.tobytes() for x in read_shard(str(name), 64, 3)] == [bytes(want[100 + k].tokens) for k in range(3, 100)]
    assert write_training_order(none, str(tmp_path / "none"), PATH, PATTERN).count() == 0
