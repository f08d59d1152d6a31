import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq

from peakfield.llm import queries, segment

PATH = public_tokenizers.path("piece_bpe_32k.model")


def every_way(text):
    """Log-probability of every segmentation of a text of characters with pieces, by its ids."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    own = pb.ModelProto()
    with open(PATH, "rb") as f:
        own.ParseFromString(f.read())
    ids = {p.piece: i for i, p in enumerate(own.pieces) if p.type == 1}

    def ways(t):
        if not t:
            yield (), 0.0
        for i in range(1, len(t) + 1):
            if t[:i] in ids:
                w = -1.5 * np.log(10 - own.pieces[ids[t[:i]]].score)
                yield from (((ids[t[:i]], *rest), w + v) for rest, v in ways(t[i:]))

    found = dict(ways("▁" + text.replace(" ", "▁")))
    whole = np.log(np.sum(np.exp(list(found.values()))))
    return {k: v - whole for k, v in found.items()}


def test_unlikely_segmentations_are_not_left_out():
    """A branch of less than 1e-16 of its state was dropped with the rounding (F2)."""
    model = segment.pieces(PATH, 1.5)
    texts = ["a", "a b", "DNA", "Et", "wurde", "Ltd", "bzw", "the"]
    for t, drawn in zip(texts, segment.sample(texts, np.arange(len(texts), dtype=np.uint64), model, 64), strict=True):
        want = every_way(t)
        got = {tuple(ids.tolist()): log_p for ids, log_p, *_ in drawn}
        assert len(drawn) == len(want) <= 64 and got.keys() == want.keys()
        assert all(abs(got[k] - v) < 1e-9 for k, v in want.items()) and all(s[3] == 1 for s in drawn)


def test_scores_of_an_unlikely_second_segmentation(spark, tmp_path):
    """Masses below 1e-16 counted as 1e-16, so alternatives were taken alike, and their scores were those of that mass (F2)."""
    n = 4000
    pq.write_table(pa.table({"doc_id": list(range(n)), "text": ["a b"] * n}), tmp_path / "documents.parquet")
    best, *rest = sorted((v for v in every_way("a b").values()), reverse=True)
    assert len(rest) == 3 and rest[0] < -40
    seconds = [r.samples[1] for r in queries.op6_segmentations(spark, str(tmp_path)).collect()]
    mass = np.log(np.sum(np.exp(rest)))
    # the highest of Gumbel variables lies 0.577 above the log of their mass in the mean
    assert abs(np.mean([s.perturbed for s in seconds]) - mass - 0.5772) < 0.1
    for v in rest[:2]:
        own = [s for s in seconds if abs(s.log_p - v) < 1e-5]
        assert abs(len(own) / n - np.exp(v - mass)) < 0.03
        # sampled with probability `inclusion`, so its inverses add up to the rows
        assert abs(sum(1 / s.inclusion for s in own) / n - 1) < 0.15


def test_long_texts_have_inclusion_scores(spark, tmp_path):
    """The scores of texts with log p below -745 were 0, and nothing told them apart (F2)."""
    texts = ["", "a", "the cat", "the cat sat " * 20, "the cat sat on a mat, and so on. " * 4000]
    pq.write_table(pa.table({"doc_id": list(range(len(texts))), "text": texts}), tmp_path / "documents.parquet")
    for r in queries.op6_segmentations(spark, str(tmp_path)).collect():
        for s in r.samples:
            assert -np.inf < s.log_inclusion <= 0
            assert s.inclusion == 0 or abs(s.log_inclusion - np.log(s.inclusion)) < 1e-5
        if r.doc_id == 4:
            # the threshold is below both perturbed values, and one for both
            a, b = (s.log_p - s.log_inclusion for s in r.samples)
            assert max(s.log_p for s in r.samples) < -745 and abs(a - b) < 1e-5 and a <= r.samples[1].perturbed + 1e-5
