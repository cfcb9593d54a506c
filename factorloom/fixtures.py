"""Small networks that examples, queries and tests share."""

from __future__ import annotations

from factorloom.model import Cpt, Network, Variable


def _binary(name: str, outcomes: tuple[str, str], tables: dict[str, tuple[tuple[str, ...], list[float]]]) -> Network:
    return Network(name, [Variable(v, outcomes) for v in tables], [Cpt(v, ps, t) for v, (ps, t) in tables.items()])


# The chest-clinic network of Lauritzen and Spiegelhalter (1988).
ASIA = _binary(
    "asia",
    ("yes", "no"),
    {
        "asia": ((), [0.01, 0.99]),
        "tub": (("asia",), [0.05, 0.95, 0.01, 0.99]),
        "smoke": ((), [0.5, 0.5]),
        "lung": (("smoke",), [0.1, 0.9, 0.01, 0.99]),
        "bronc": (("smoke",), [0.6, 0.4, 0.3, 0.7]),
        "either": (("lung", "tub"), [1.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 1.0]),
        "xray": (("either",), [0.98, 0.02, 0.05, 0.95]),
        "dysp": (("bronc", "either"), [0.9, 0.1, 0.8, 0.2, 0.7, 0.3, 0.1, 0.9]),
    },
)

# The family-out (dog) problem of Charniak (1991).
DOG = _binary(
    "dog",
    ("true", "false"),
    {
        "family-out": ((), [0.15, 0.85]),
        "bowel-problem": ((), [0.01, 0.99]),
        "light-on": (("family-out",), [0.6, 0.4, 0.05, 0.95]),
        "dog-out": (("bowel-problem", "family-out"), [0.99, 0.01, 0.97, 0.03, 0.9, 0.1, 0.3, 0.7]),
        "hear-bark": (("dog-out",), [0.7, 0.3, 0.01, 0.99]),
    },
)
