"""Named queries over the given tables and the SQL they must agree with."""

from importlib import import_module

MODULES = ["windows", "mining", "evidence", "catalogue", "fleet", "runs", "tools"]


def load():
    from teleproof.checks import registry

    for name in MODULES:
        import_module(f"teleproof.checks.{name}")
    return dict(registry.QUERIES), dict(registry.TWINS)
