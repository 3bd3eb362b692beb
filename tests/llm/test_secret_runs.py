"""Entropy spans of runs that join a secret to a key or to what a pattern holds."""
import random
import string

from textquarry.llm import secrets as S


def test_key_before_a_hex_secret():
    rng = random.Random(8)
    hits = 0
    for _ in range(300):
        token = "".join(rng.choice("0123456789abcdef") for _ in range(24))
        alone = [x["kind"] for x in S.scan(token)]
        behind = S.scan("session=" + token)
        assert len(behind) >= len(alone)
        hits += bool(behind)
    assert hits > 280
    upper = "".join(rng.choice("0123456789ABCDEF") for _ in range(64))
    assert any(x["kind"] == "entropy" and x["end"] == 68 for x in S.scan("key/" + upper))


def test_secret_beside_a_hex_id():
    rng = random.Random(9)
    token = "".join(rng.sample(string.ascii_letters + string.digits, 32))
    for text in (f"{token}/{'0123456789abcdef' * 2}", f"{'0123456789abcdef' * 2}={token}"):
        found = S.scan(text)
        assert [x["kind"] for x in found if x["kind"] == "hex"] == ["hex"]
        assert any(x["kind"] == "entropy" and token[:20] in text[x["start"] : x["end"]] for x in found)
    assert not S.scan("some/long/path/of-words-only/and-2024/more_words_here")
