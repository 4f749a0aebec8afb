from strandlake.llm.media import FRAME, HOP, fingerprint, landmarks, padded


def feature(text):
    times, codes = fingerprint(padded(text.encode()))
    return times.tobytes(), codes.tobytes()


def test_short_texts_have_features_of_their_own():
    texts = ["word", "words", "no id at all", "a b c d e f g", "the cat sat on the mat", "the cat sat on the hat", "x" * 63, "x" * 64, "long " * 100, "long " * 140]
    assert len({feature(t) for t in texts}) == len(texts) and all(feature(t)[0] for t in texts)


def test_last_bytes_count():
    for n in (60, 100, 447, 512, 640, 703, 704, 768, 960, 3000, 5000):
        text = ("the quick brown fox jumps over a lazy dog; " * 200)[:n]
        assert len({feature(text[:-3] + end) for end in ("qzk", "AB.", "mno", "...")}) == 4


def test_every_sample_is_inside_several_frames():
    for n in (64, 128, 704, 768, 1024):
        assert len(landmarks(bytes(range(1, 65)) * (n // 64))) == (n + FRAME - 2 * HOP) // HOP + 1


def test_silence_has_no_pairs():
    assert feature("") == (b"", b"") and len(fingerprint(bytes(640))[0]) == 0
