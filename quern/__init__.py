"""A Spark-native columnar analytics engine: striped datasets with statistics manifests."""
