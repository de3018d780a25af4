"""quoteloom: price-coverage analytics and corpus preparation on Spark DataFrames."""
