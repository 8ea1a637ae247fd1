"""A long text has the spans that it has in one piece."""

import numpy as np

from burnline.llm import secret_scan


def test_blocks_change_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    field = secret_scan.Field(rng.normal(size=(sum(secret_scan.SIZES), 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    field.step[:, 0] += 3
    field.weights[:1600, 0] += 1
    signs = list("abcXYZ0189_+/-  \n=:\"é.")
    texts = ["".join(rng.choice(signs, 60_000)), ("token = " + "".join(rng.choice(list("aB3"), 30)) + " plain words ") * 900, "aB3" * 9000, "x" * 5000 + " = " + "aB3" * 5000]
    whole = secret_scan.scan_texts(texts, field)
    assert whole[0]
    monkeypatch.setattr(secret_scan, "BLOCK", 1500)
    assert [secret_scan.scan_texts([t], field)[0] for t in texts] == whole
