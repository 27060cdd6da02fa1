"""op8 compresses a window once with each different dictionary."""

import numpy as np

from umbra.llm import toxicity as T

WINDOWS = [b"idiot", b"idiots", b"weather", b"a", b"stupid", b"\xc3\xa9t\xc3\xa9", b"xqzjkvwxqzjkvwpfgh", b"the"]


def a_part(bad: list[bytes]) -> T.Part:
    return T.part_of([(w, 3) for w in bad], T.dictionary([(b"the", 9), (b"weather", 5), (b"and", 8)], 8192), 1, 32_768)


def gain(part: T.Part, window: bytes) -> int:
    """As the method has it, one dictionary after the other."""
    data = T.widened(b" %b " % window)
    t, plain = (len(T.compressor(c).compress(data)) for c in (part.toxic, part.ordinary))
    return T.NONE if t - part.floor > 10 and 2 * t >= len(data) + 20 + part.floor else plain - t - max(0, t - part.floor)


def test_widened_bytes_are_linear_functions():
    b = np.arange(256, dtype=np.uint8)
    want = np.stack([b, b * np.uint8(167) + np.uint8(13), b * np.uint8(91) + np.uint8(7)], 1).tobytes()
    assert T.widened(bytes(range(256))) == want and T.widened(b"") == b""


def test_each_different_dictionary_compresses_a_window_once(monkeypatch):
    wide, narrow = a_part([b"idiot", b"stupid", b"moron", b"clown"]), a_part([b"idiot", b"moron"])
    parts = [wide, wide, wide, narrow, narrow, None, None]
    want = [tuple(gain(p, w) if p else T.NONE for p in parts) for w in WINDOWS]
    want = [(T.NONE,) * 7 if x[0] == T.NONE else x for x in want]
    calls, real = [], T.compressor

    class Counting:
        def __init__(self, content):
            self.inner = real(content)

        def compress(self, data):
            calls.append(bytes(data))
            return self.inner.compress(data)

    monkeypatch.setattr(T, "compressor", Counting)
    measured = T.distances(parts)
    for w, x in zip(WINDOWS, want, strict=True):
        assert measured([w]) == x
    assert max(map(calls.count, calls)) <= 3  # two toxic dictionaries and the ordinary one; one for each part before: up to 10
    assert measured([]) == (T.NONE,) * 7 and T.distances([None, None])([b"idiot"]) == (T.NONE,) * 2
    assert any(x[0] > 0 for x in want) and any(x[0] == T.NONE for x in want)
    for p in (wide, narrow):
        assert [p.distance()([w]) for w in WINDOWS] == [gain(p, w) for w in WINDOWS]
