from tidemark.operators import regression
from tidemark.plans import models


def test_gradient_boosting_fits_the_operators_own_rounds(spark, monkeypatch):
    fitted, fit = [], regression.fit

    def watched(*args):
        fitted.append(fit(*args))
        return fitted[-1]

    monkeypatch.setattr(regression, "fit", watched)
    models.gradient_boosting(spark, "/root/testdata/sf0.001")
    assert [model.getNumTrees for _, model in fitted] == [regression.gradient_boosting().getMaxIter()] == [30]
