"""peakloom: mass-spectrometry analytics and corpus preparation on Spark DataFrames."""
