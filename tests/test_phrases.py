"""The inputs that are classified come from whole tables."""

from holdfast import catalog
from holdfast.plans.fixtures import view

FOLDER = "/root/testdata/sf0.001"


def test_every_event_gives_its_phrases(spark):
    users = view(spark, FOLDER, "conversations").where("role = 'user'").count()
    assert catalog.queries()["classify_inputs"](spark, FOLDER).count() == users + 8 * view(spark, FOLDER, "events").count()
