"""Creates the document table: ``python -m payspark.sources.create [--path PATH]``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from payspark.sources.store import DocumentStore, store_path


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Create the table of documents if there is none.")
    parser.add_argument("--path", default=store_path())
    path = parser.parse_args(arguments).path
    DocumentStore(SparkSession.builder.getOrCreate(), path).init()
    print(f"document table at {path}")


if __name__ == "__main__":
    main()
