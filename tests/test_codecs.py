import numpy as np
import pytest

from quillspark.functions import codecs


def test_mxfp4():
    w = bytes([0x21, 0xF9] + [0] * 14)
    v = codecs.mxfp4(w, bytes([128]))
    assert v[:4].tolist() == [1.0, 2.0, -1.0, -12.0] and not v[4:].any() and len(v) == 32
    for bad in (bytes([255]), bytes(2)):
        with pytest.raises(ValueError):
            codecs.mxfp4(w, bad)


@pytest.mark.parametrize("bits", [3, 6, 8])
def test_affine_round_trip(bits):
    v = np.random.default_rng(1).normal(size=640).astype(np.float32)
    c, e, z = codecs.affine(v, bits, 32)
    assert len(c) == 640 * bits // 8
    step = np.repeat(np.exp2(e.astype(float)), 32)
    assert (np.abs(codecs.unaffine(c, e, z, bits, 32) - v) <= step).all()
    c, e, z = codecs.affine(np.zeros(32), bits, 32)
    assert not codecs.unaffine(c, e, z, bits, 32).any()


def test_bf16():
    assert codecs.bf16(np.array([1.5, -2.0], "<f4").view("<u4").__rshift__(16).astype("<u2").tobytes()).tolist() == [1.5, -2.0]


def test_in_spark(spark):
    rows = [("a", bytes(range(16)), bytes([127])), ("a", bytes(16), bytes([127]))]
    out = codecs.merged_errors(codecs.requantize(spark.createDataFrame([(n, bytearray(w), bytearray(s)) for n, w, s in rows], "name string, weight binary, scale binary"), 8)).collect()
    assert [(r.name, r.n) for r in out] == [("a", 64)] and out[0].max_error < 0.05
    d = spark.createDataFrame([("a 'b'",), ("a 'b",), (None,)], "c string")
    assert [r[0] for r in d.select(codecs.quotes_close("c")).collect()] == [True, False, None]
