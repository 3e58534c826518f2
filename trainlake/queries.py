"""Registry of the queries of the time-series, text-corpus and retrieval operators."""

from .catalog import registry


def _load() -> None:
    from .catalog import corpus, extras, ledgers, readers, retrieval, rounds, samples, streams, training  # noqa: F401


def queries() -> dict:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.ORACLES)
