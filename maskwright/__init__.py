"""Detection and removal of personal data in document collections, on Spark."""
