"""The model queries ask for the whole job: the operators' own settings, folds and members. No fit is run."""

import inspect
from types import SimpleNamespace
from unittest.mock import MagicMock

import pytest

from callgauge.operators import modeling as md
from callgauge.plans.catalog import models

ASKED = {
    "random_search": {"k": 3}, "compare_architectures": {"rounds": 150, "trees": 200, "k": 3, "stack_folds": 3}, "validate_new_features": {"rounds": 100, "k": 3},
    "time_series_cv": {"k": 5}, "feature_set_ablation": {}, "stack_models": {"folds": 3},
}


@pytest.fixture
def called(monkeypatch):
    seen = {}

    def spy(name):
        signature = inspect.signature(getattr(md, name))

        def call(*args, **options):
            bound = signature.bind(*args, **options)
            bound.apply_defaults()
            seen[name] = bound.arguments
            return MagicMock()

        return call

    for name in ASKED:
        monkeypatch.setattr(md, name, spy(name))
    monkeypatch.setattr(models, "_split", lambda t: (MagicMock(), MagicMock()))
    monkeypatch.setattr(models, "_ready", lambda t, **_: (MagicMock(), MagicMock(), []))
    monkeypatch.setattr(models, "_indexed", lambda t: (MagicMock(), 100))
    for module, name in ((models.ag, "fold_summary"), (models.ev, "classification_metrics")):
        monkeypatch.setattr(module, name, MagicMock())
    monkeypatch.setattr(models.F, "col", MagicMock())
    return seen


@pytest.mark.parametrize("name", sorted(ASKED))
def test_settings_are_the_operators_own(called, name):
    getattr(models, name)(SimpleNamespace(stored_scored=MagicMock()))
    assert {k: called[name][k] for k in ASKED[name]} == ASKED[name]
    if name == "random_search":
        assert called[name]["settings"] == md.random_settings(20) and len(called[name]["settings"]) == 20
    if name == "time_series_cv":
        assert set(called[name]["models"]) == set(md.validation_models()) and set(called[name]["sets"]) == {"text", "lexicon", "combined"}
    if name in ("feature_set_ablation", "stack_models"):
        assert set(called[name]["models" if name == "feature_set_ablation" else "base"]) == {"logistic", "forest", "boosted"}


def test_vote_has_all_members(called, monkeypatch):
    fits = []
    for name in ("fit_logistic", "fit_forest", "fit_boosted_classifier"):
        monkeypatch.setattr(md, name, lambda *a, name=name, **k: fits.append(name))
    monkeypatch.setattr(md, "scored", MagicMock())
    monkeypatch.setattr(md, "soft_vote", MagicMock())
    models.soft_vote(SimpleNamespace())
    assert fits == ["fit_logistic", "fit_forest", "fit_boosted_classifier"]
