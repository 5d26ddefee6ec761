"""Secrets that the base patterns do not cover, when they stand more than once."""

import random
import string

import pytest

from lectern.llm import secrets


@pytest.mark.parametrize("gap", [0, 300, 980, 1000, 1020])
def test_copies_of_a_key_do_not_hide_each_other(gap):
    rng = random.Random(gap)
    for n in (24, 40, 64):
        key = "".join(rng.choices(string.ascii_letters + string.digits, k=n - 2)) + "a1"
        line = f"Authorization: Bearer {key}\n"
        text = line + "plain words of a page " * (gap // 22) + "." * (gap % 22) + "\n" + line + f"see {key} above\n"
        at = [i for i in range(len(text)) if text.startswith(key, i)]
        assert [x for x in secrets.scan(text) if x[2] == "novel"] == [(i, i + n, "novel") for i in at] and len(at) == 3


def test_repeated_identifiers_stay_out():
    for word in ("client_secret_key_version_2", "authorization_server_metadata_2", "token_authorization_server_metadata_2"):
        for times in (1, 2, 4):
            assert secrets.scan(f"session {word}\n" * times) == []
