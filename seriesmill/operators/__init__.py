"""Operators on panel time series: features, grids, imputation, models, forecasts, cross-validation."""
