"""The models: gradients, held-out accuracy, expectation-maximisation, character model."""

import numpy as np
import pytest
import pyarrow as pa

from corpusloom.llm import language, repetition
from corpusloom.llm.gru import ByteGRU


def test_gru_gradients():
    rng = np.random.default_rng(0)
    model = ByteGRU(3, embed=4, hidden=5)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    ids = np.array([[65, 66, 67, 0], [68, 69, 0, 0], [70, 0, 0, 0]], np.uint8)
    y = np.array([0, 1, 2])

    def loss():
        x = model.logits(ids)
        x = x - np.log(np.exp(x).sum(axis=2, keepdims=True))
        live = ids != 0
        picked = np.take_along_axis(x, y[:, None, None].repeat(4, 1), axis=2)[:, :, 0]
        return -((picked * live).sum(axis=1) / live.sum(axis=1)).mean()

    g = model._gradient(ids, y)
    for name, p in model.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in p.shape)
            if name == "E":
                at = (65, at[1])
            eps, old = 1e-4, p[at]
            p[at] = old + eps
            up = loss()
            p[at] = old - eps
            down = loss()
            p[at] = old
            assert abs((up - down) / (2 * eps) - g[name][at]) < 2e-3, name


TEXTS = {
    "en": "the people of the town often say that this harvest is better than the other one and they will go to the market",
    "fr": "les habitants de la commune disent souvent que cette récolte est plus belle que les autres et ils vont au marché",
    "de": "die Leute aus dem Dorf sagen oft, dass diese Ernte besser ist als die anderen und sie gehen auf den Markt",
    "ja": "町の人々はこの収穫が他のものより良いと言っています。そして市場へ行きます。",
}


def test_language_of_held_out_texts():
    rows = [(" ".join(np.random.default_rng(i).permutation(t.split()[: -4] if lang != "ja" else [t])), lang) for i in range(20) for lang, t in TEXTS.items()]
    model = language.fit(rows, steps=150)
    held = ["they say that the market is better", "ils disent que la commune est belle", "sie sagen, dass die Leute besser sind", "収穫が良い", "", None]
    lines = language.batch_lines(model, "test", pa.array(held)).to_pylist()
    best = [min(range(9), key=lambda i: (r[0]["packed"] >> (7 * i)) & 127) if r else None for r in lines]
    assert [language.LANGUAGES[i] if i is not None else None for i in best] == ["en", "fr", "de", "ja", None, None]


def test_expectation_maximisation():
    p = repetition.posteriors({"00000": 900, "11111": 60, "10000": 5, "22222": 20, "02111": 15})
    assert p["11111"] > 0.9 and p["10000"] >= repetition.POSTERIOR and p["00000"] < 0.01 and p["02111"] < repetition.POSTERIOR
    p = repetition.posteriors({"00000": 900, "11111": 60, "10000": 5, "21111": 20, "20000": 15, "22222": 3})
    assert p["21111"] > 0.9 and p["20000"] < 0.1 and p["20000"] < p["22222"] < p["21111"]
    assert repetition.posteriors({}) == {}


@pytest.mark.parametrize("clean", [100, 100_000, 10**9, 10**12])
@pytest.mark.parametrize("rest", [{}, {"11111": 50}, {"11111": 10**6, "01111": 10**5}, {"02111": 3000, "20000": 10**4}])
def test_rare_repetition_is_kept(clean, rest):
    p = repetition.posteriors({"10000": 5, "00000": clean, **rest})
    assert p["10000"] >= repetition.POSTERIOR and p["00000"] < repetition.POSTERIOR
