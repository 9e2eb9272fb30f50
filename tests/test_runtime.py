import pytest

from meridian.runtime import get_text, own_dir, put_text, scratch


def test_no_folder_of_one_machine_on_a_cluster():
    assert own_dir("local[8]") and own_dir("local")
    for master in ("yarn", "spark://host:7077", "k8s://https://host", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            own_dir(master)


def test_small_files_round_trip(spark):
    path = scratch(spark, "text") + "/state.json"
    assert get_text(spark, path) is None
    for text in ("", "äöü\n", "second"):
        put_text(spark, path, text)
        assert get_text(spark, path) == text
