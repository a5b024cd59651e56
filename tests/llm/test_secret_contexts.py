"""Values after credential words that the base patterns miss or hold in part."""

import math
import random

import pytest

from logloom.llm import secrets


@pytest.mark.parametrize(
    "text, want",
    [
        ("my password is Xk9$vQ2mL7pR, keep it", "my password is [secret], keep it"),
        ('password: "v@$$K0rb-91xQz"', 'password: "[secret]"'),
        ("aws_secret_access_key = wJalrXUtnFEMI/K7MDENG/bPxRfiCYzzSAMPLEKQ", "aws_secret_access_key = [secret]"),
        ("db_pwd=tR7#kPq2!vLm9", "db_pwd=[secret]"),
        ("ssh_private_key: b3BlbnNzaC1rZXktdjEAAA", "ssh_private_key: [secret]"),
        ("password=Abc123$%^Qwe789zz ok", "[secret] ok"),
        ("pwd: kJxQvWzRtYpLmNb", "pwd: [secret]"),
        ("secret token password: q8#Zt!w2Lp0x", "secret token password: [secret]"),
        ("Authorization: Bearer q8.Zt-w2Lp0xYz", "Authorization: Bearer [secret]"),
        ("token: 84920571630284", "[secret]"),
    ],
)
def test_values_go_whole(text, want):
    assert secrets.redact_text(text) == want


@pytest.mark.parametrize("text", ["the password requirements", "the secret is unfortunately known", "login information, tokens.", '{"pwd":"abc","user":"someone-else-77"}', "password: [secret]"])
def test_prose_stays(text):
    assert secrets.redact_text(text) == text


RANKS = secrets.word_ranks()


@pytest.mark.parametrize("text", ["login: photosynthesis", "passphrase: mountaineering", "pwd = wonderfulness", "token -> configuration", "the password Verantwortung", "secret is: informationen"])
def test_words_are_no_secrets(text):
    assert secrets.redact_text(text, ranks=RANKS) == text


@pytest.mark.parametrize(
    "text, value",
    [
        ("secret_one_two_three_four_five_six = gX7#pQ2vR9zLk4", "gX7#pQ2vR9zLk4"),
        ("token_" + "x" * 90 + ": gX7#pQ2vR9zLk4", "gX7#pQ2vR9zLk4"),
        ("password XKJWQPZLMRTVBN", "XKJWQPZLMRTVBN"),
        ("password => q8#Zt!w2Lp0x", "q8#Zt!w2Lp0x"),
        ("token -> q8#Zt!w2Lp0x", "q8#Zt!w2Lp0x"),
        ("pwd := q8#Zt!w2Lp0x", "q8#Zt!w2Lp0x"),
        ("password:\tq8#Zt!w2Lp0x", "q8#Zt!w2Lp0x"),
        ("my login\tis\tq8#Zt!w2Lp0x", "q8#Zt!w2Lp0x"),
    ],
)
def test_names_and_signs_of_any_kind(text, value):
    assert secrets.redact_text(text, ranks=RANKS) in (text.replace(value, "[secret]"), "[secret]")


def test_precision_on_random_and_plain_values():
    r = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    hard = ["".join(r.choice(letters) for _ in range(r.randint(10, 24))) for _ in range(300)]
    plain = r.sample([w for w in RANKS if w.isascii() and 8 <= len(w)], 300)
    found = [v for v in hard + plain if secrets.guess_spans(f"login: {v}", [], ranks=RANKS)]
    assert sum(v in found for v in hard) >= 295 and not set(plain) & set(found)


def test_long_texts_take_linear_time():
    assert secrets.scan_text("token_" * 40_000 + " = x")["spans"] == ""
    assert secrets.scan_text("token_" * 40_000)["spans"] == ""


def every_split(value):
    """The least cost over all splits, each part tried at every place."""
    best = [0.0] + [math.inf] * len(value)
    for i in range(1, len(value) + 1):
        for j in range(i):
            part, costs = value[j:i], []
            if i - j == 1:
                costs.append(1.0)
            if i - j >= 3:
                costs += [secrets.word_cost(part, secrets._RANK), secrets.date_cost(part)]
                if len(set(part)) == 1:
                    costs.append(secrets.repeat_cost(i - j))
                if all(secrets._next_to(a.lower(), b.lower()) for a, b in zip(part, part[1:])):
                    costs.append(secrets.walk_cost(i - j))
            best[i] = min([best[i], *(best[j] + c for c in costs if c is not None)])
    return best[-1]


def test_guess_cost_is_the_least_of_all_splits():
    r = random.Random(5)
    parts = ["qwerty", "asdf", "pass", "Password", "p@ss", "1999", "2001-12-31", "12/11/2020", "311299", "aaaa", "sssss", "111", "0000", "x", "Z9", "zxc", "dragon", "key", "987", "654321", "20201231", "red", "1.2.20", "ßaa", "İ"]
    values = ["".join(r.choice(parts) for _ in range(r.randint(1, 6))) for _ in range(2000)]
    values += ["".join(r.choice("aassdfqwe12203.9/-") for _ in range(r.randint(1, 24))) for _ in range(1000)]
    for v in values:
        assert secrets.log10_guesses(v) == pytest.approx(every_split(v), abs=1e-9), v


def test_values_of_one_kind_of_character_count():
    spans = lambda text: secrets.scan_text(text)["spans"]
    assert spans("passphrase: correct-horse-battery-staple") == "guess:12:40"
    assert spans("pwd = XkjWqPzLmRtVbN") == "guess:6:20"
