"""lodestone: Spark-native analytics for potential-field surveys and block models."""
