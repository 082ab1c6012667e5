"""Model tournament, metrics, calibration, batch prediction and explanation on Spark ML."""
