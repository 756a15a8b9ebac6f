"""Random strings inside longer runs."""

import random
import string

from framelake.llm import secret_scan
from framelake.llm.vocab import default_path, rank_encoding

ENC = rank_encoding(default_path("byte_bpe_50k.tiktoken"))


def found(text):
    return [text[a:b] for a, _, b in secret_scan.random_spans(text, secret_scan.base_spans(text), ENC, 2.0)]


def test_random_keys_inside_readable_runs():
    r = random.Random(3)
    for _ in range(200):
        key = "".join(r.choices(string.ascii_letters + string.digits, k=24))
        digest = "".join(r.choices("0123456789abcdef", k=40))
        for text in (f"org/internal/deployments/production/configuration/{key}", f"my_production_service_account_private_key={key}", f"repos/{digest}/blob/{key}", f"internal/deployments/{key}/production/configuration/settings"):
            got = found(text)
            assert len(got) == 1 and key in got[0] and digest not in got[0]


def test_readable_runs_and_digests_are_no_secrets():
    for text in ("com/example/project/internal/deployments/ProductionConfigurationFactoryBean", "https/www/example/com/articles/2024/01/how-to-bake-bread-at-home-in-3-easy-steps", "user_id=123e4567-e89b-12d3-a456-426614174000/settings/production/configuration", "release/configuration/production/" + "0123456789ABCDEF" * 4, "-" * 500):
        assert found(text) == []
    assert found("internal_deployments/" * 20_000) == []
