"""DataFrame operators: binning, transforms, surfaces, features, information, segments, analysis."""
