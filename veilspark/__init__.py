"""Personal data detection and de-identification on Spark DataFrames."""
