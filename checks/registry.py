"""All registered queries by name."""

from __future__ import annotations

from checks import corpus_checks, exchange_checks, prediction_checks, source_checks, validation_checks

CHECKS = {}
for module in (prediction_checks, corpus_checks, validation_checks, exchange_checks, source_checks):
    for name, check in module.CHECKS.items():
        if name in CHECKS:
            raise ValueError(f"query registered twice: {name}")
        CHECKS[name] = check
