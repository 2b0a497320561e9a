"""Spark-native analytics for controlled text perturbation and paired response evaluation."""
