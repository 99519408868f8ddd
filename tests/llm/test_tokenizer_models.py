"""Hand-made models of every kind against the library: normalisers, white space, user-defined pieces, unknown characters, unigram scores."""

import itertools

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from rasterloom.llm import sentencepiece_fst as S

PIECES = "▁ a b c d e t h ab abc bc ▁a ▁ab ▁t ▁th he the ▁the cd de ea ae ▁▁ é 1 2 12 ア ガ".split(" ")


def model(kind, rule="identity", bytes_=False, user=(), pieces=PIECES, seed=0, **options):
    rng = np.random.default_rng(seed)
    m = pb.ModelProto()
    if rule != "identity":
        m.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        del m.pieces[:]
    m.trainer_spec.model_type = kind
    m.trainer_spec.byte_fallback = bytes_
    m.normalizer_spec.add_dummy_prefix = options.get("prefix", True)
    m.normalizer_spec.remove_extra_whitespaces = options.get("extra", False)
    m.normalizer_spec.escape_whitespaces = True
    m.trainer_spec.treat_whitespace_as_suffix = options.get("suffix", False)
    for name, type_ in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        m.pieces.add(piece=name, score=0, type=type_)
    for u in user:
        m.pieces.add(piece=u, score=0, type=4)
    if bytes_:
        for b in range(256):
            m.pieces.add(piece=f"<0x{b:02X}>", score=0, type=6)
    order = rng.permutation(len(pieces))
    for i, p in enumerate(pieces):
        m.pieces.add(piece=p, score=-float(order[i]) if kind == 2 else -float(np.float32(rng.random() * 8)), type=1)
    return m.SerializeToString()


def texts(seed):
    rng = np.random.default_rng(seed)
    fixed = ["", " ", "a", "  the  abc ", "a\tb\nc", "ﬁ Ａｂｃ ①② ㌀ ｶﾞ é  x", "thethe the", "zzz qq", "​ a　b", "<x><x>ab", "a<x>", "▁a▁▁b", "日本 ab", "ab  "]
    made = ["".join(rng.choice(list("abcdeth é12日ｶﾞﬁ  <x>　①"), n)) for n in rng.integers(1, 60, 150)]
    return fixed + made


CASES = [
    dict(kind=kind, rule=rule, bytes_=b, extra=extra, prefix=prefix, user=user)
    for kind, (rule, extra), b, prefix, user in itertools.product((1, 2), (("identity", False), ("nmt_nfkc", True), ("nmt_nfkc_cf", False)), (False, True), (False, True), ((), ("<x>", "ab<")))
]
CASES += [dict(kind=kind, suffix=True, extra=extra, pieces=[p[1:] + "▁" if p.startswith("▁") and len(p) > 1 else p for p in PIECES]) for kind in (1, 2) for extra in (False, True)]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_equal_to_the_library(case):
    data = model(seed=case, **CASES[case])
    lib = sentencepiece.SentencePieceProcessor(model_proto=data)
    fst = S.Transducer(S.read_model(None, data))
    for t in texts(case):
        assert fst.encode(t) == lib.encode(t), t
        assert fst.decode(fst.encode(t)) == lib.decode(lib.encode(t)), t


def test_unigram_path_is_the_shortest():
    """Against all segmentations."""
    data = model(1, seed=5)
    fst = S.Transducer(S.read_model(None, data))
    p = fst.pieces

    def cost(parts):
        return sum(p.scores[fst.arcs[x]] if x in fst.arcs else fst.lowest if len(x) == 1 else -1e9 for x in parts)

    for text in ("▁abcde", "▁thethe", "ab▁the", "zab"):
        cuts = [[text[i:j] for i, j in itertools.pairwise((0, *c, len(text)))] for k in range(len(text)) for c in itertools.combinations(range(1, len(text)), k)]
        found = [p.names[x] if isinstance(x, int) else x for x in fst.path(text)]
        assert abs(cost(found) - max(map(cost, cuts))) < 1e-4


def test_workers_tell_models_apart(spark):
    """Two models of equal size, kind and last piece, one after the other in the same workers."""
    df = spark.createDataFrame([(i, "the abc the") for i in range(20)], "doc_id long, text string")
    import tempfile

    got = []
    for seed in (1, 2, 3):
        data = model(1, seed=seed)
        with tempfile.NamedTemporaryFile(suffix=".model") as f:
            f.write(data)
            f.flush()
            rows = S.encode_table(df, model=f.name).collect()
        want = sentencepiece.SentencePieceProcessor(model_proto=data).encode("the abc the")
        assert all(list(r.ids) == want for r in rows)
        got.append(tuple(want))
    assert len(set(got)) > 1
