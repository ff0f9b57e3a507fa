"""Source-file tables for tests."""


def files(spark, rows):
    return spark.createDataFrame(
        [(k, "s", kind, path, len(text), text) for k, kind, path, text in rows],
        "package_key string, server_name string, registry_type string, path string, bytes long, text string")
