"""PySpark-native analytics for governing language-model traffic and text corpora."""
